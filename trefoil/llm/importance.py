"""Importance resampling towards a target corpus by hashed n-grams.

Both corpora are counted by n-gram bucket; a bucket's gain is the log ratio of its smoothed shares in the target and in the
raw text, a document's weight the sum of the gains of its n-grams, and the draw takes the highest weights after seeded
Gumbel noise, which is sampling without replacement in proportion to exp(weight).

N-grams are interned piece by piece in an open-addressed table of NumPy arrays: keys are XXH64 of the bytes, and two
occurrences share a slot only if their bytes are equal. A slot holds bucket and count, so the bucket hash is taken once a
distinct n-gram; occurrences keep their slot ids, through which the gains are gathered. A piece holds at most PIECE_BYTES
of text: long documents are cut between words, with the words that n-grams need beyond the cut.

Two passes over the text, counts then weights. A task of the first pass sends one row a bucket, so at most tasks x buckets
small rows are shuffled; the driver receives one row a bucket (10,000) and the second pass carries the gains in its closure. Only
(doc_id, weight, score) is sorted, in ranges, never in one task.

Defined cases: a null, empty or wordless text has no n-grams and weight 0; very long texts are read whole; ties in the
score go to the smaller doc_id, null last; of rows equal in both, the draw takes as many as it needs, and ``resample`` keeps all
of them; a null doc_id gets the noise of the text ``null``; an empty table gives no rows, an empty target only lowers common
buckets; further columns are kept by ``weigh`` and ``resample``, and a column named ``_importance`` is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from trefoil.llm import common as C

ORDERS, BUCKETS = 3, 10_000
SMOOTHING = 10_000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
PIECE_BYTES = 1 << 18
ROWS = 1024
WEIGHT = "struct<n_words:bigint,n_features:bigint,weight:bigint>"
#: Bytes outside words become spaces: words are 0-9, a-z and all of UTF-8 beyond ASCII, after lower-casing A-Z.
_BREAK = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: bytes | None) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join((text or b"").lower().translate(_BREAK).split())


def pieces(texts: list[bytes], orders: int, most: int = PIECE_BYTES) -> Iterator[tuple[bytes, list[int], int]]:
    """(lines joined by a line feed, row number of each line, bytes in which n-grams may start)."""
    lines, rows, size = [], [], 0
    for row, text in enumerate(texts):
        if size + len(text) > most and lines:
            yield b"\n".join(lines), rows, size
            lines, rows, size = [], [], 0
        if len(text) <= most:
            lines.append(text)
            rows.append(row)
            size += len(text) + 1
            continue
        at = 0
        while at < len(text):
            cut = text.find(b" ", at + most)
            cut = end = len(text) if cut < 0 else cut + 1
            for _ in range(orders - 1):
                end = len(text) if (space := text.find(b" ", end + 1)) < 0 else space
            yield text[at:end], [row], cut - at
            at = cut
    if lines:
        yield b"\n".join(lines), rows, size


# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(text: bytes, words: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many slices of ``text`` at once; ``words`` has the eight bytes from each place on. Slices of 32 bytes and more
    go to the library, one by one."""
    h = length.astype(np.uint64) + (np.uint64(seed) + _P5)
    for lane in range(3):
        to = np.flatnonzero(length >= 8 * lane + 8)
        x = _turn(words[start[to] + 8 * lane] * _P2, 31) * _P1
        h[to] = _turn(h[to] ^ x, 27) * _P1 + _P4
    place = start + (length & ~7)
    to = np.flatnonzero(length & 4)
    h[to] = _turn(h[to] ^ (words[place[to]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    place[to] += 4
    for left in range(3):
        to = np.flatnonzero((length & 3) > left)
        h[to] = _turn(h[to] ^ (words[place[to] + left] & np.uint64(0xFF)) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    to = np.flatnonzero(length >= 32)
    h[to] = [xxhash.xxh64_intdigest(text[a:a + n], seed) for a, n in zip(start[to].tolist(), length[to].tolist())]
    return h


def _crc_tables() -> np.ndarray:
    """Tables of CRC-32 (reflected polynomial 0xEDB88320) for a byte followed by 0 to 7 others."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    out = [table]
    for _ in range(7):
        out.append((out[-1] >> np.uint32(8)) ^ table[out[-1] & np.uint32(255)])
    return np.stack(out)


_CRC = _crc_tables()


def crc32(text: bytes, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of many slices of ``text`` at once (see ``xxh64``)."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)

    def take(to: np.ndarray, place: np.ndarray, many: int) -> None:
        seen = (words[place] ^ crc[to]).view(np.uint8).reshape(-1, 8)
        fresh = _CRC[many - 1][seen[:, 0]]
        for n in range(1, many):
            fresh ^= _CRC[many - 1 - n][seen[:, n]]
        crc[to] = fresh if many >= 4 else fresh ^ (crc[to] >> np.uint32(8 * many))

    for lane in range(3):
        to = np.flatnonzero(length >= 8 * lane + 8)
        take(to, start[to] + 8 * lane, 8)
    place = start + (length & ~7)
    for many in (4, 2, 1):
        to = np.flatnonzero(length & many)
        take(to, place[to], many)
        place[to] += many
    crc ^= np.uint32(0xFFFFFFFF)
    to = np.flatnonzero(length >= 32)
    crc[to] = [zlib.crc32(text[a:a + n]) for a, n in zip(start[to].tolist(), length[to].tolist())]
    return crc


class Interned:
    """Distinct n-grams of a piece in an open-addressed table; ``slot`` has the slot of each occurrence."""

    def __init__(self, text: bytes, start: np.ndarray, end: np.ndarray, buckets: int):
        size = 1 << max(4, int(2 * len(start)).bit_length())
        self._words = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))
        self._start, self._length = start, end - start
        keys = xxh64(text, self._words, start, self._length, SEED)
        owner = np.full(size, -1, np.int32)
        at = (keys & np.uint64(size - 1)).astype(np.int32)
        self.slot = np.empty(len(start), np.int32)
        pending = np.arange(len(start), dtype=np.int32)
        while len(pending):
            place = at[pending]
            free = owner[place] < 0
            owner[place[free]] = pending[free]  # the last of those that meet at a free slot gets it
            held = owner[place]
            same = keys[held] == keys[pending]
            same[same] = self._equal(held[same], pending[same])
            self.slot[pending[same]] = place[same]
            pending = pending[~same]
            at[pending] = (at[pending] + 1) & (size - 1)
        self.used = np.flatnonzero(owner >= 0)
        first = owner[self.used]
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int32)
        self.bucket[self.used] = crc32(text, self._words, start[first], self._length[first]) % np.uint32(buckets)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of two lists of occurrences agree, eight at a time."""
        same = self._length[a] == self._length[b]
        rest = np.flatnonzero(same & (a != b))
        x, y, left = self._start[a[rest]], self._start[b[rest]], self._length[a[rest]]
        while len(rest):
            differ = self._words[x] ^ self._words[y]
            part = left < 8
            differ[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
            same[rest[differ != 0]] = False
            more = (differ == 0) & (left > 8)
            rest, x, y, left = rest[more], x[more] + 8, y[more] + 8, left[more] - 8
        return same


def occurrences(piece: bytes, limit: int, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and line numbers of all n-grams of a piece, and the line numbers of its words."""
    raw = np.frombuffer(piece, np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = (raw == 32) | (raw == 10)
    start, end = np.flatnonzero(gap[:-2] & ~gap[1:-1]), np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    line = np.cumsum(raw == 10)[start] if len(start) else start
    starts, ends, lines = [], [], []
    for n in range(1, orders + 1):
        count = max(0, len(start) - n + 1)
        whole = (line[:count] == line[n - 1:]) & (start[:count] < limit) if count else np.zeros(0, bool)
        starts.append(start[:count][whole])
        ends.append(end[n - 1:][whole] if count else end[:0])
        lines.append(line[:count][whole])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(lines), line[start < limit]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [normal(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """N-grams of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for piece, _, limit in pieces(_texts(batch.slice(at, ROWS)), orders):
                    start, end, _, _ = occurrences(piece, limit, orders)
                    table = Interned(piece, start, end, buckets)
                    total += np.bincount(table.bucket[table.used], table.count[table.used], buckets).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:  # one row a bucket
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray, smoothing: int = SMOOTHING) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    raw_all, target_all = int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(((t + 1) * (raw_all + smoothing)) / ((s + 1) * (target_all + smoothing))))
        for s, t in zip(raw.tolist(), target.tolist())
    ], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """``docs`` with a struct ``_importance``: words, n-grams and weight of each text."""
    docs = docs.drop("_importance")
    field = StructType.fromDDL(f"_importance {WEIGHT}")["_importance"]
    out, arrow = StructType([*docs.schema.fields, field]), to_arrow_type(field.dataType)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = np.zeros((3, part.num_rows), np.int64)
                for piece, rows, limit in pieces(_texts(part), orders):
                    start, end, line, word_line = occurrences(piece, limit, orders)
                    table, rows = Interned(piece, start, end, len(gain)), np.array(rows)
                    slot_gain = gain[table.bucket]
                    n = len(rows)
                    found[0, rows] += np.bincount(word_line, minlength=n)
                    found[1, rows] += np.bincount(line, minlength=n)
                    found[2, rows] += np.bincount(line, slot_gain[table.slot], n).astype(np.int64)
                result = pa.StructArray.from_arrays([pa.array(x) for x in found], fields=list(arrow))
                yield pa.RecordBatch.from_arrays([*part.columns, result], names)

    return docs.mapInArrow(run, out)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a row in thousandths, rounded down, from sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(u)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_importance`` (see ``weigh``) and ``_score``, weight plus noise."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return weigh(docs, gain).withColumn("_score", F.col("_importance.weight") + noise(F.col("doc_id"), seed))


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """A stored table of doc_id, n_words and score with ``rank``: 1, 2, ... for the drawn rows, null for the others."""
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    drawn = scores.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = C.global_index(scores.where(able), order, "importance_ranked", "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    return placed.withColumn("rank", rank).unionByName(scores.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, with their columns. Rows that tie with the last one drawn in score and doc_id stay."""
    table = C.stored(scored(docs, target, seed), "importance_scored")
    small = table.select("doc_id", F.col("_importance.n_words").alias("n_words"), F.col("_score").alias("score"))
    last = ranked(small, percent, least_words).where("rank is not null").orderBy(F.desc("rank")).first()
    if last is None:
        return table.limit(0).select(*docs.columns)
    here = F.coalesce(F.col("doc_id") <= last["doc_id"], F.lit(False)) if last["doc_id"] is not None else F.lit(True)
    taken = (F.col("_score") > last["score"]) | ((F.col("_score") == last["score"]) & here)
    return table.where((F.col("_importance.n_words") >= least_words) & taken).select(*docs.columns)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    found = scored(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    table = C.stored(found.select("doc_id", "_importance.*", F.col("_score").alias("score")), "importance_scores")
    return ranked(table).select("doc_id", "n_features", "weight", "score", "rank")
