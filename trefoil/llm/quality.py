"""Quality scores by positive-unlabelled learning.

A linear model over shape features of the whole text minimises the non-negative unbiased risk: trusted positives, web
text without labels, and the share of positives in that text, which is estimated first from how a plain
positives-against-web model ranks the two (the least ratio of their upper tails). Negative labels are never used.

Fitting takes at most FIT_ROWS positives and FIT_ROWS web documents, the first by a seeded hash of doc_id; every document
is scored. Rows whose crc32(doc_id) mod 4 is 2 are left out of both samples.

Defined cases: a null, empty or blank text has all features zero and is scored like any other; without positives
or documents to fit, every score is the prior, 0.5; rows that repeat a doc_id are scored alike; an empty table gives no
rows; further columns are passed by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.llm import common as C

FIT_ROWS = 15_000
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
SEED = 42
_CLASS = np.zeros(256, np.int64)
for _n, _chars in enumerate([b"#*$%&|<>", b"!?", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"()-", bytes(range(128, 256))], 1):
    _CLASS[list(_chars)] = _n


def features(text: str | None) -> np.ndarray:
    """Shape features of one whole text."""
    raw = (text or "").encode()
    found = raw.split()
    if not found:
        return np.zeros(WIDTH)
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)[:9]
    share = counts / len(raw)
    letters = counts[3] + counts[4] + counts[8]
    n, seen = len(found), Counter(found)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    twice = len(lines) - len(set(lines))
    same = sum(a == b for a, b in zip(found, found[1:]))
    top = seen.most_common(1)[0][1] / n
    pairs = len(set(zip(found, found[1:]))) / max(1, n - 1)
    symbol_words = sum(w[-1] in b"#*$%&|<>!" for w in found) / n
    return np.array([
        np.log1p(n) / 10, len(b"".join(found)) / n / 10, *np.sqrt(share[[1, 2, 5, 7, 0]]), share[3], counts[3] / max(1, letters), share[8],
        len(seen) / n, pairs, same / n, top, twice / len(lines), symbol_words, np.sqrt(symbol_words), np.sqrt(same / n),
        np.sqrt(counts[3] / max(1, letters)), np.sqrt(twice / len(lines)), float(n < 30), max(map(len, found)) / 100,
        len(lines) / n, np.sqrt(counts[1] / n), np.sqrt(counts[2] / n),
    ])


WIDTH = 25


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD, F.lit(False))


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Weights of a linear score over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, prior: float):
        self.mean, self.scale, self.weight, self.prior = mean, scale, weight, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weight[:-1] + self.weight[-1], -30, 30)))


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Adam, from zero."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _push(z: np.ndarray, w: np.ndarray, sign: float) -> np.ndarray:
    """Gradient of the mean logistic loss for label ``sign``."""
    return -sign * (z * (1 / (1 + np.exp(np.clip(sign * (z @ w), -30, 30))))[:, None]).mean(axis=0)


def _loss(z: np.ndarray, w: np.ndarray, sign: float) -> float:
    return float(np.logaddexp(0, -sign * (z @ w)).mean())


def estimate_prior(positive: np.ndarray, web: np.ndarray) -> float:
    """Share of positives in ``web`` from scores of both: where only positives rank, the tails' ratio is that share."""
    cuts = np.quantile(positive, np.linspace(0.01, 0.6, 60))
    upper = np.array([(web >= c).mean() + 1 / np.sqrt(len(web)) for c in cuts]) / np.array([(positive >= c).mean() for c in cuts])
    return float(np.clip(upper.min(), 0.05, 0.98))


def fit(positive: np.ndarray, web: np.ndarray, prior: float | None = None, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Non-negative PU fit of feature rows; ``prior`` is estimated unless given."""
    if not len(positive) or not len(web):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), 0.5)
    mean, scale = web.mean(axis=0), web.std(axis=0) + 1e-6
    one = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = one(positive), one(web)
    if prior is None:
        plain = _descend(lambda w: 0.5 * (_push(p, w, 1) + _push(u, w, -1)) + decay * w, WIDTH + 1, steps, rate)
        prior = estimate_prior(p @ plain, u @ plain)

    def gradient(w: np.ndarray) -> np.ndarray:
        negative = _loss(u, w, -1) - prior * _loss(p, w, -1)
        pull = _push(u, w, -1) - prior * _push(p, w, -1)
        # A negative risk below zero is overfitting: step back up on it alone.
        return (prior * _push(p, w, 1) + pull if negative >= 0 else -pull) + decay * w

    return Model(mean, scale, _descend(gradient, WIDTH + 1, steps, rate), prior)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = SEED) -> Model:
    """A model from bounded samples of ``docs``; both are at most ``rows`` rows."""
    mine = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    trusted = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    turn = F.xxhash64(F.lit(seed), "doc_id")
    first = lambda ids: [r[0] for r in ids.orderBy(turn, "doc_id").limit(rows).collect()]
    spark = docs.sparkSession
    positive, web = first(mine.join(trusted, "doc_id", "left_semi")), first(mine)
    ids = C.rows_of(spark, [(i,) for i in sorted({*positive, *web})], "doc_id bigint")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    x = {r["doc_id"]: r["x"] for r in featured(sample).collect()}
    table = lambda which: np.array([x[i] for i in which]).reshape(-1, WIDTH)
    return fit(table(positive), table(web))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
