"""Repeated word windows by fixed-block anchors.

A window is WINDOW consecutive words. Every document's non-overlapping blocks of BLOCK words are the index, and as
2 * BLOCK - 1 <= WINDOW each window holds a whole block of its document. Every rolling run of BLOCK words of every document
probes the index: at other places than its own blocks it hits if the index has its hash, at its own blocks if the index has it
twice. Of two equal windows each holds a hit, namely where the other has its block. Hits extend to the windows
around them. Their words' 128-bit BLAKE2b digests are compared over the whole corpus (the shorter hashes of the index only
choose candidates); the windows found again are joined to maximal runs.

1. blocks: a task sends each different block hash of a batch once; they are gathered by filter segment.
2. The index as Bloom filters of fixed size (all blocks; blocks found twice) is broadcast. It lets some extra candidates
   through, never fewer. For a corpus whose blocks overfill it, raise ``segments``.
3. questions: windows around hits. Windows that a batch holds twice are settled there; it asks about each different window
   once, so that a passage in a third of all documents asks a row a batch and not a row a document. What is settled goes
   straight to its document's bucket.
4. answers return to the document's bucket, where they meet the texts.

Defined cases: a null, empty or blank text has no words, and one of fewer than WINDOW words keeps all; very long texts and words are
read whole; windows that overlap themselves count; rows that repeat a doc_id and text
are each other's copies; a null doc_id is kept; an empty table gives no rows; further columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.llm import common as C
from trefoil.llm import rolling as R

WINDOW, BLOCK = 35, 18
#: Filter segments of 64 KB each: 32 MB a filter.
SEGMENTS = 512
_ASK = np.dtype([("key", "<u8"), ("more", "<u8"), ("twice", "<u4"), ("ref", "<i8"), ("start", "<i4")])
_ANSWER = np.dtype([("ref", "<i8"), ("start", "<i4")])


def packed(buckets: np.ndarray, records: np.ndarray, kind: int = 0, press: zstandard.ZstdCompressor | None = None) -> pa.RecordBatch:
    """One row a bucket, holding its records column by column, compressed."""
    order = np.argsort(buckets, kind="stable")
    buckets, records = buckets[order], records[order]
    firsts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else np.zeros(0, int)
    ends = np.r_[firsts[1:], len(buckets)] if len(buckets) else firsts
    names, press = records.dtype.names, press or zstandard.ZstdCompressor(level=3)
    data = []
    for a, b in zip(firsts, ends):
        part = records[a:b]
        data.append(press.compress(part.tobytes() if names is None else b"".join(part[c].tobytes() for c in names)))
    return pa.RecordBatch.from_arrays([
        pa.array(buckets[firsts].astype(np.int32), pa.int32()), pa.array(np.full(len(firsts), kind, np.int32), pa.int32()),
        pa.array((ends - firsts).astype(np.int32), pa.int32()), pa.array(data, pa.binary()),
    ], ["bucket", "kind", "n", "data"])


PACKED = "bucket int, kind int, n int, data binary"


def unpacked(table: pa.Table, kind: np.dtype, which: int = 0, press: zstandard.ZstdDecompressor | None = None) -> np.ndarray:
    """The records of all rows of one kind."""
    columns = (table[c].to_pylist() for c in ("kind", "n", "data"))
    rows = [(n, data) for k, n, data in zip(*columns) if k == which]
    out, at, press = np.zeros(sum(n for n, _ in rows), kind), 0, press or zstandard.ZstdDecompressor()
    for n, data in rows:
        raw, place = press.decompress(data), 0
        if kind.names is None:
            out[at:at + n] = np.frombuffer(raw, kind)
        else:
            for c in kind.names:
                size = n * kind[c].itemsize
                out[c][at:at + n] = np.frombuffer(raw[place:place + size], kind[c].base).reshape((n, *kind[c].shape))
                place += size
        at += n
    return out


def filters(sent: DataFrame, segments: int, both: bool = True, widen=None) -> list[R.Bloom]:
    """Bloom filters of the hashes in ``sent`` (packed by segment; kind 1 if their batch had them twice): of those
    found twice, and with ``both`` of all. Their size is fixed by ``segments``. ``widen`` makes 64-bit hashes of
    a segment's shortened ones."""
    record = np.dtype("<u8") if widen is None else np.dtype("<u4")

    def build(table: pa.Table) -> pa.Table:
        segment = table["bucket"][0].as_py()
        once, double = unpacked(table, record), unpacked(table, record, 1)
        hashes, twice = np.concatenate([once, double]), np.r_[np.zeros(len(once), bool), np.ones(len(double), bool)]
        if widen is not None:
            hashes = widen(segment, hashes)
        order = np.argsort(hashes, kind="stable")
        hashes, twice = hashes[order], twice[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        many = (np.diff(np.r_[first, len(hashes)]) > 1) | (np.maximum.reduceat(twice, first) > 0)
        out = []
        for chosen in ([hashes[first]] if both else []) + [hashes[first][many]]:
            part = R.Bloom(1)  # the bits within a segment don't depend on their number
            part.add(chosen)
            out.append(part.data.tobytes())
        return pa.table({"segment": pa.array([segment], pa.int32()), "all": [out[0]], "many": [out[-1]]})

    rows = sent.groupBy("bucket").applyInArrow(build, "segment int, all binary, many binary").collect()
    size = R.Bloom.SEGMENT_BITS // 8
    out = [R.Bloom(segments), R.Bloom(segments)]
    for row in rows:
        for bloom, data in zip(out, (row["all"], row["many"])):
            bloom.data[row["segment"] * size:(row["segment"] + 1) * size] = np.frombuffer(data, np.uint8)
    return out


def sendable(hashes: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """A batch's different hashes, packed by filter segment."""
    found, counts = np.unique(hashes, return_counts=True)
    for kind, part in enumerate((found[counts == 1], found[counts > 1])):
        yield packed(R.Bloom.segment_of(part, segments).astype(np.int64), part, kind)


def rows_with_refs(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, ``ref`` (a hash of both) and ``home`` (the bucket where answers meet the text, by ref)."""
    text = C.text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("ref"))
    return rows.withColumn("home", F.pmod("ref", F.lit(buckets)).cast("int"))


def blocks(rows: DataFrame, block: int, segments: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [R.windows_hash(R.word_hashes(t), block)[::block] for t in batch.column("text").to_pylist()]
            if found:
                yield from sendable(np.concatenate(found), segments)

    return rows.select("text").mapInArrow(run, PACKED)


def candidates(words: np.ndarray, window: int, block: int, every: R.Bloom, many: R.Bloom) -> np.ndarray:
    """Starts of the windows that hold a hit."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    probes = R.windows_hash(words, block)
    hit = every.has(probes)
    hit[::block] = many.has(probes[::block])
    at, last = np.flatnonzero(hit), len(words) - window
    steps = np.zeros(len(words) + 2, np.int32)
    np.add.at(steps, np.maximum(at - (window - block), 0), 1)
    np.add.at(steps, at + 1, -1)
    return np.flatnonzero(np.cumsum(steps[:last + 1]) > 0)


def window_names(text: str, starts: np.ndarray, window: int) -> np.ndarray:
    """128 bits of BLAKE2b, as two integers, of the words of each window, joined by a space."""
    words = text.encode().split()
    ends = np.cumsum([len(w) + 1 for w in words])
    line, digest = b" ".join(words), hashlib.blake2b
    spans = zip((ends - [len(w) + 1 for w in words])[starts].tolist(), (ends[starts + window - 1] - 1).tolist())
    return np.frombuffer(b"".join([digest(line[a:b], digest_size=16).digest() for a, b in spans]), "<u8").reshape(-1, 2)


def questions(rows: DataFrame, filter_bytes: Broadcast, segments: int, window: int, block: int, buckets: int) -> DataFrame:
    """Kind 0: asked windows by key; kind 1: windows settled in their batch, on their way to the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, many = (R.Bloom(segments, np.frombuffer(b, np.uint8)) for b in filter_bytes.value)
        for batch in batches:
            found = []
            for text, ref in zip(*(batch.column(c).to_pylist() for c in ("text", "ref"))):
                words = R.word_hashes(text)
                starts = candidates(words, window, block, every, many)
                if not len(starts):
                    continue
                part = np.zeros(len(starts), _ASK)
                part["key"], part["more"] = window_names(text, starts, window).T
                part["ref"], part["start"] = ref, starts
                found.append(part)
            if not found:
                continue
            asks = np.concatenate(found)
            asks = asks[np.lexsort((asks["more"], asks["key"]))]
            new = np.r_[True, (asks["key"][1:] != asks["key"][:-1]) | (asks["more"][1:] != asks["more"][:-1])]
            first = np.flatnonzero(new)
            counts = np.diff(np.r_[first, len(asks)])
            once = asks[first].copy()
            once["twice"] = counts > 1
            yield packed((once["key"] % np.uint64(buckets)).astype(np.int64), once)
            known = asks[np.repeat(counts > 1, counts)]
            if len(known):
                yield packed(known["ref"] % buckets, known, 1)

    return rows.select("text", "ref").mapInArrow(run, PACKED)


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """Windows found again, packed by their document's bucket."""

    def decide(table: pa.Table) -> pa.Table:
        asks, known = unpacked(table, _ASK), unpacked(table, _ASK, 1)
        if len(asks):
            asks = asks[np.lexsort((asks["more"], asks["key"]))]
            new = np.r_[True, (asks["key"][1:] != asks["key"][:-1]) | (asks["more"][1:] != asks["more"][:-1])]
            first = np.flatnonzero(new)
            counts = np.diff(np.r_[first, len(asks)])
            again = (counts > 1) | (np.maximum.reduceat(asks["twice"], first) > 0)
            # Windows asked with twice set are among the known ones already.
            asks = asks[np.repeat(again, counts) & (asks["twice"] == 0)]
        both = np.concatenate([asks, known])
        out = np.zeros(len(both), _ANSWER)
        out["ref"], out["start"] = both["ref"], both["start"]
        return pa.Table.from_batches([packed(both["ref"] % buckets, out)])

    return asked.groupBy("bucket").applyInArrow(decide, PACKED)


def starts_by_ref(table: pa.Table) -> dict[int, np.ndarray]:
    found = unpacked(table, _ANSWER)
    found = found[np.argsort(found["ref"], kind="stable")]
    first = np.flatnonzero(np.r_[True, found["ref"][1:] != found["ref"][:-1]]) if len(found) else []
    return dict(zip(found["ref"][first].tolist(), np.split(found["start"], first[1:]))) if len(found) else {}


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words left, joined by a space) of every row."""
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    buckets = 2 * C.partitions(spark)
    rows = rows_with_refs(docs, buckets)
    every, many = filters(blocks(rows, block, segments), segments)
    shared = spark.sparkContext.broadcast([every.data.tobytes(), many.data.tobytes()])
    found = answers(questions(rows, shared, segments, window, block, buckets), buckets)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        starts, out = starts_by_ref(right), []
        for doc_id, text, ref in zip(*(left[c].to_pylist() for c in ("doc_id", "text", "ref"))):
            words = (text or "").encode().split()
            gone = R.covered(starts[ref], window, len(words)) if ref in starts else np.zeros(len(words), bool)
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            out.append((doc_id, len(words), int(gone.sum()), kept.decode()))
        return pa.Table.from_pylist(
            [dict(zip(("doc_id", "n_words", "n_removed", "kept"), r)) for r in out],
            pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return rows.groupBy("home").cogroup(found.withColumnRenamed("bucket", "home").groupBy("home")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept string")


def op9_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(C.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
