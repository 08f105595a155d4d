"""Repeated byte strings by a sampled suffix order.

The suffixes that are sorted are those at sampled places, a difference cover chosen by content: of each window of LENGTH
bytes the place whose following GRAM bytes hash lowest (the leftmost one). Equal windows have their sample at the
same offset, so a window is the bytes before its sample and a prefix of the suffix there.

1. Samples whose GRAM bytes occur once in the corpus can't lie in a repeated window. Tasks send each different hash of a
   batch once, and a Bloom filter of those found twice (fixed size, broadcast) keeps the other samples; it may keep more.
2. Sorted triples: a kept sample is named by three characters of 17 bytes, which reach over LENGTH bytes. Samples go to the
   bucket of their first GRAM bytes and are sorted by their triples there. A name that spans LENGTH bytes decides
   every comparison that is asked for, so the recursion on names ends at this level, whatever the corpus.
3. The remaining suffixes, those between samples, are merged in by their bytes up to the sample and the order of its suffix.
4. Adjacent prefixes: suffixes that share the window's remaining bytes are neighbours in the order; among them, windows with
   the same bytes before the sample are equal, and those of a document above the smallest doc_id are removed.

Samples whose surroundings a task has seen in a smaller document are settled there, so copies of a text or passage send a row
a task, not a row a document. The task's table of surroundings has a fixed size; what it forgets is asked again. The bytes that
are sent are compressed with a shared dictionary, made from a few texts, which decides no result.

Defined cases: a null text is empty, and one shorter than LENGTH keeps all; rows that share a doc_id don't remove each other; a null
doc_id counts as larger than all others; an empty table gives no rows; further columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.llm import common as C
from trefoil.llm import rolling as R
from trefoil.llm.anchors import PACKED, filters, packed, rows_with_refs, unpacked

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: 256 filter segments of 64 KB.
SEGMENTS = 256
#: Samples that a task holds before it sends them.
HELD_ROWS = 120_000
#: Surroundings that a task remembers (16 bytes each).
SLOTS = 1 << 21
#: Texts, bytes of each, and size of the dictionary for compression.
DICTIONARY_TEXTS, DICTIONARY_PART, DICTIONARY_BYTES = 400, 8192, 1 << 16
#: Windows of one text looked at together; bounds memory on very long texts.
_CHUNK = 1 << 20
_NO_ID = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)
_ASK = np.dtype([("doc", "<i8"), ("ref", "<i8"), ("start", "<i4"), ("before", "u1"), ("windows", "u1"), ("bytes", "u1", (LENGTH + SPAN - 1,))])
_ANSWER = np.dtype([("ref", "<i8"), ("start", "<i4"), ("windows", "<i4")])


def samples(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``hash, place, first, last`` (inclusive) of the runs of window starts with one sample. Hashes have 40 bits."""
    total = len(raw) - LENGTH + 1
    for at in range(0, max(total, 0), _CHUNK):
        part = raw[at:at + _CHUNK + LENGTH - 1].astype(np.uint64) + np.uint64(1)
        grams = R.windows_hash(part, GRAM)
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while reach < SPAN:  # minima over doubling reaches
            step = min(reach, SPAN - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        last = np.r_[first[1:], len(low)] - 1
        # Lowest hashes are small numbers: mixed again, they spread evenly over filter segments.
        yield R.mix(low[first] >> np.uint64(24)) >> np.uint64(24), (low[first] & _PLACE).astype(np.int64) + at, first + at, last + at


def widened(segment: int, low: np.ndarray) -> np.ndarray:
    """64-bit hashes of 40-bit ones, given as segment (their top byte) and the rest."""
    mixed = R.mix(low.astype(np.uint64) + (np.uint64(segment) << np.uint64(32)))
    return (mixed & ~np.uint64(0xFF << 48)) | (np.uint64(segment) << np.uint64(48))


def widened_all(hashes: np.ndarray) -> np.ndarray:
    return (R.mix(hashes) & ~np.uint64(0xFF << 48)) | ((hashes >> np.uint64(32)) << np.uint64(48))


def grams(rows: DataFrame) -> DataFrame:
    """Each batch's different sample hashes, 4 bytes each, packed by segment; kind 1: in the batch twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for t in batch.column("text").to_pylist() for h, *_ in samples(np.frombuffer(t.encode(), np.uint8))]
            if not found:
                continue
            # A place may own several runs at the edges of chunks; counting it twice only lets it pass the filter.
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            for kind, part in enumerate((hashes[counts == 1], hashes[counts > 1])):
                yield packed((part >> np.uint64(32)).astype(np.int64), part.astype(np.uint32), kind)

    return rows.select("text").mapInArrow(run, PACKED)


class Seen:
    """The document in which surroundings were last asked about, in a table of fixed size where a later entry replaces an
    earlier one of its slot."""

    def __init__(self, slots: int):
        self.keys, self.docs = np.zeros(slots, np.uint64), np.full(slots, _NO_ID)

    def below(self, keys: np.ndarray, doc: int) -> np.ndarray:
        """Which keys are known from a document smaller than ``doc``; the others are then known from ``doc``."""
        slots = (keys % np.uint64(len(self.keys))).astype(np.int64)
        known = (self.keys[slots] == keys) & (self.docs[slots] < doc)
        self.keys[slots[~known]] = keys[~known]
        self.docs[slots[~known]] = doc
        return known


def dictionary(rows: DataFrame) -> bytes:
    """What the compressor knows beforehand; empty if there are too few texts to learn from."""
    some = rows.where("text != ''").select(F.left("text", F.lit(DICTIONARY_PART)).alias("text")).limit(DICTIONARY_TEXTS)
    texts = [r["text"].encode() for r in some.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t[a:a + 512] for t in texts for a in range(0, len(t), 512)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(known: bytes) -> zstandard.ZstdCompressor:
    if not known:
        return zstandard.ZstdCompressor(level=3)
    data = zstandard.ZstdCompressionDict(known)
    data.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=data)


def decompressor(known: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs of windows (in order within their document) with those that touch made one."""
    new = np.r_[True, (runs["ref"][1:] != runs["ref"][:-1]) | (runs["start"][1:] != runs["start"][:-1] + runs["windows"][:-1])]
    out = runs[new]
    out["windows"] = np.add.reduceat(runs["windows"], np.flatnonzero(new))
    return out


def questions(rows: DataFrame, filter_bytes: Broadcast, known_bytes: Broadcast, buckets: int) -> DataFrame:
    """Kind 0: samples by bucket, with the bytes of their windows; kind 1: windows settled in their task."""
    width = LENGTH + SPAN - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = R.Bloom(SEGMENTS, np.frombuffer(filter_bytes.value, np.uint8))
        seen, press = Seen(SLOTS), compressor(known_bytes.value)
        found, hashes, settled, held = [], [], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            if settled:
                runs = _joined(np.concatenate(settled))
                yield packed(runs["ref"] % buckets, runs, 1)
            if found:
                yield packed((np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64), np.concatenate(found), 0, press)

        for batch in batches:
            for at in range(batch.num_rows):
                doc, text, ref = (batch.column(c)[at].as_py() for c in ("doc_id", "text", "ref"))
                doc = _NO_ID if doc is None else doc
                raw = np.frombuffer(text.encode(), np.uint8)
                padded = np.r_[raw, np.zeros(width, np.uint8)]
                for hashed, place, first, last in samples(raw):
                    keep = many.has(widened_all(hashed))
                    if not keep.any():
                        continue
                    hashed, place, first, last = hashed[keep], place[keep], first[keep], last[keep]
                    low, high = first[0], last[-1] + LENGTH
                    key = R.spans_hash(raw[low:high].astype(np.uint64) + np.uint64(1), first - low, last - low + LENGTH)
                    known = seen.below(key ^ R.mix(((place - first) * 64 + last - first).astype(np.uint64)), doc)
                    if known.any():
                        runs = np.zeros(np.count_nonzero(known), _ANSWER)
                        runs["ref"], runs["start"], runs["windows"] = ref, first[known], (last - first)[known] + 1
                        settled.append(_joined(runs))
                    hashed, place, first, last = hashed[~known], place[~known], first[~known], last[~known]
                    part = np.zeros(len(place), _ASK)
                    part["doc"], part["ref"] = doc, ref
                    part["start"], part["before"], part["windows"] = first, place - first, last - first + 1
                    own = padded[first[:, None] + np.arange(width)]
                    own[np.arange(width) >= (last - first + LENGTH)[:, None]] = 0
                    part["bytes"] = own
                    found.append(part)
                    hashes.append(hashed)
                    held += len(place)
                if held >= HELD_ROWS or len(settled) >= HELD_ROWS:
                    yield from sent()
                    found, hashes, settled, held = [], [], [], 0
        yield from sent()

    return rows.select("doc_id", "text", "ref").mapInArrow(run, PACKED)


def repeated(asks: np.ndarray) -> np.ndarray:
    """For the samples of one bucket: which of their windows (by offset before the sample) are in a smaller document."""
    n, width = len(asks), LENGTH + SPAN - 1
    before = asks["before"].astype(np.int64)
    flat = np.concatenate([asks["bytes"].reshape(-1), np.zeros(LENGTH + width, np.uint8)])
    at = np.arange(n) * width
    # The suffix at the sample: three characters of 17 bytes, as big-endian numbers in order.
    ends = np.arange(LENGTH + 1)
    suffix = flat[(at + before)[:, None] + ends]
    suffix[before[:, None] + ends >= width] = 0
    wide = np.zeros((n, 56), np.uint8)
    wide[:, :LENGTH + 1] = suffix
    columns = wide.view(">u8").astype(np.uint64)
    order = np.lexsort(columns.T[::-1])
    ranked = suffix[order]
    differs = np.ones((n, LENGTH + 1), bool)
    differs[1:] = ranked[1:] != ranked[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH + 1)  # prefix shared with the one before
    shared[:1] = 0
    docs, before, windows = asks["doc"][order], before[order], asks["windows"][order].astype(np.int64)
    start = at[order] + before
    out = np.zeros((n, SPAN), bool)
    left = np.zeros(n, np.uint64)
    for offset in range(SPAN):
        if offset:  # one more byte before the sample
            byte = flat[np.maximum(start - offset, 0)].astype(np.uint64)
            left = R.mix(left * np.uint64(0x9E3779B97F4A7C15) + byte + np.uint64(1))
        mine = np.flatnonzero((offset <= before) & (offset > before - windows))
        if len(mine) < 2:
            continue
        alike = np.cumsum(shared < LENGTH - offset)[mine].astype(np.uint64)
        group = R.mix(left[mine] + alike * np.uint64(0xC2B2AE3D27D4EB4F))
        by = np.lexsort((docs[mine], group))
        new = np.r_[True, group[by][1:] != group[by][:-1]]
        first = np.flatnonzero(new)
        least = np.repeat(docs[mine][by][first], np.diff(np.r_[first, len(by)]))
        out[mine[by], offset] = docs[mine][by] > least
    back = np.zeros_like(out)
    back[order] = out
    return back


def answers(asked: DataFrame, known_bytes: Broadcast, buckets: int) -> DataFrame:
    """Runs of removed windows, packed by their document's bucket."""

    def decide(table: pa.Table) -> pa.Table:
        asks = unpacked(table, _ASK, 0, decompressor(known_bytes.value))
        out = [unpacked(table, _ANSWER, 1)]
        if len(asks):
            # By window start: offset ``before`` comes first.
            marks = repeated(asks)
            column = asks["before"].astype(np.int64)[:, None] - np.arange(SPAN)
            by_start = np.where(column >= 0, marks[np.arange(len(asks))[:, None], np.maximum(column, 0)], False)
            edges = np.diff(np.pad(by_start.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(edges == 1)
            _, end = np.nonzero(edges == -1)
            found = np.zeros(len(row), _ANSWER)
            found["ref"], found["start"], found["windows"] = asks["ref"][row], asks["start"][row] + first, end - first
            out.append(found)
        both = np.concatenate(out)
        return pa.Table.from_batches([packed(both["ref"] % buckets, both)])

    return asked.groupBy("bucket").applyInArrow(decide, PACKED)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes) of every row."""
    spark = docs.sparkSession
    buckets = 2 * C.partitions(spark)
    rows = rows_with_refs(docs, buckets)
    many = filters(grams(rows), SEGMENTS, both=False, widen=widened)[1]
    known = spark.sparkContext.broadcast(dictionary(rows))
    found = answers(questions(rows, spark.sparkContext.broadcast(many.data.tobytes()), known, buckets), known, buckets)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        runs = unpacked(right, _ANSWER)
        runs = runs[np.argsort(runs["ref"], kind="stable")]
        at, out = np.searchsorted(runs["ref"], left["ref"].to_numpy(), "left"), []
        to = np.searchsorted(runs["ref"], left["ref"].to_numpy(), "right")
        for doc_id, text, a, b in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), at.tolist(), to.tolist()):
            raw = np.frombuffer(text.encode(), np.uint8)
            steps = np.zeros(len(raw) + 1, np.int32)
            np.add.at(steps, runs["start"][a:b], 1)
            np.add.at(steps, runs["start"][a:b] + runs["windows"][a:b] + LENGTH - 1, -1)
            gone = np.cumsum(steps[:-1]) > 0
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
            out.append((doc_id, len(raw), int(gone.sum()), spans, raw[~gone].tobytes()))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=list(names))

    return rows.groupBy("home").cogroup(found.withColumnRenamed("bucket", "home").groupBy("home")).applyInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(C.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
