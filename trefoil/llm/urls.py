"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams of host and path.

The longest rule that fits decides. URLs without a rule are judged by a model trained on a small labelled URL table: a bounded
sample (FIT_URLS rows at most, the first by a seeded hash of the URL) of labelled URLs, fitted on the driver by full-batch
gradient steps, so reruns agree. In the query the labelled table is what the rules decide among the pages themselves. Every
URL is split by column expressions and scored in one pass over (id, url); nothing is shuffled but the sample, and only the
weights (2^16 numbers) travel to the tasks. Rules are one column expression, so their number is bounded by MOST_RULES.

Defined cases: a null URL or one without ``://`` has an empty host and path, which no rule fits, and gets the model's verdict
on no n-grams; an empty host or path likewise; very long URLs are read whole; two fitting rules of equal length: the longer
host wins, then the earlier rule; equal URLs get equal verdicts; without labelled URLs every other URL is allowed; an empty
table gives no rows; further columns are kept, and columns named ``_host``, ``_path``, ``_rule``, ``_verdict`` are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIT_URLS = 5000
MOST_RULES = 500
SIZES = (3, 4, 5)
BITS = 16
SEED = 42
STEPS, RATE, DECAY = 200, 0.3, 1e-4
ALLOW, BLOCK = "allow", "block"
ROWS = 1024
OWN = ("_host", "_path", "_rule", "_verdict")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


# The rules of the query.
RULES = [
    Rule("com", "/", ALLOW),
    Rule("example.com", "/en/", BLOCK),
    Rule("www.example.com", "/en/", ALLOW),
    Rule("net", "/es/", BLOCK),
    Rule("net", "/fr/", BLOCK),
]


def split(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    part = lambda n: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` + ``path``, and its verdict; null without one."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} at most")
    first = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    if first:
        name = F.coalesce(*[F.when(fits(r), F.lit(r.host + r.path)) for r in first])
        verdict = F.coalesce(*[F.when(fits(r), F.lit(r.verdict)) for r in first])
    return name, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path, which have spaces of their own."""
    found = set()
    for mark, part in ((b"h", host), (b"p", path)):
        raw = b"^" + part.encode() + b"$" if part else b""
        for n in SIZES:
            found.update(zlib.crc32(mark + raw[i:i + n]) for i in range(len(raw) - n + 1))
    return np.unique(np.fromiter(found, np.int64, len(found)) & ((1 << BITS) - 1))


def _sparse(urls: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the n-gram matrix, whose rows have length one."""
    rows = [grams(*u) for u in urls]
    sizes = np.array([len(r) for r in rows], np.int64)
    column = np.concatenate([*rows, np.zeros(0, np.int64)])
    return np.repeat(np.arange(len(rows)), sizes), column, np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)


class Model:
    """Weights of the hashed n-grams and a bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def score(self, urls: list[tuple[str, str]]) -> np.ndarray:
        """Probability that each (host, path) is to be blocked."""
        row, column, value = _sparse(urls)
        return 1 / (1 + np.exp(-(np.bincount(row, self.weight[column] * value, len(urls)) + self.bias)))


def fit(urls: list[tuple[str, str]], blocked: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Logistic regression by Adam steps from zero over all of ``urls``."""
    size = 1 << BITS
    if not urls:
        return Model(np.zeros(size), 0.0)
    row, column, value = _sparse(urls)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[column] * value, len(urls)) + w[-1]
        off = (1 / (1 + np.exp(-z)) - blocked) / len(urls)
        g = np.append(np.bincount(column, off[row] * value, size), off.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-1], float(w[-1]))


def train(labelled: DataFrame, most: int = FIT_URLS, seed: int = SEED) -> Model:
    """A model from rows of (host, path, verdict): at most ``most`` distinct ones, by a seeded hash."""
    table = labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select("host", "path", "verdict").distinct()
    order = [F.xxhash64(F.lit(seed), "host", "path"), "host", "path", "verdict"]
    rows = table.orderBy(*order).limit(most).collect()  # bounded by ``most``
    return fit([(r["host"], r["path"]) for r in rows], np.array([r["verdict"] == BLOCK for r in rows], float))


def parts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict."""
    host, path = split(pages["url"])
    pages = pages.drop(*OWN).withColumns({"_host": host, "_path": path})
    rule, verdict = matched(F.col("_host"), F.col("_path"), rules)
    return pages.withColumns({"_rule": rule, "_verdict": verdict})


def judge(pages: DataFrame, model: Model, rules: list[Rule]) -> DataFrame:
    """``pages`` with host, path, rule and verdict: the rule's, else the model's."""
    table = parts(pages, rules)
    schema, names = table.schema, table.columns
    place = [names.index(c) for c in OWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                host, path, _, verdict = (part.column(i).to_pylist() for i in place)
                open_ = [i for i, v in enumerate(verdict) if v is None]
                for i, p in zip(open_, model.score([(host[i], path[i]) for i in open_])):
                    verdict[i] = BLOCK if p > 0.5 else ALLOW
                columns = list(part.columns)
                columns[place[3]] = pa.array(verdict, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return table.mapInArrow(run, schema)


def keep_allowed(pages: DataFrame, model: Model, rules: list[Rule]) -> DataFrame:
    """The rows of ``pages`` that are not blocked, with their columns."""
    return judge(pages, model, rules).where(F.col("_verdict") == ALLOW).select(*pages.columns)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = train(parts(pages, RULES).select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_verdict").alias("verdict")))
    return judge(pages, model, RULES).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
