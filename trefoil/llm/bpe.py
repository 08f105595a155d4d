"""Byte-level BPE over whole texts, long ones in overlapping chunks.

A text longer than CHUNK characters is cut into chunks that reach OVERLAP characters into the next one. Tasks pre-tokenise
chunks independently and report the token boundaries in their first and last OVERLAP characters. Where a chunk and its
successor agree on a boundary between a character and white space, both streams run alike from there on (no match of
the pattern holds white space after another character, whatever stands before), so the text is cut there. A pair
without such a boundary (one word longer than the overlap) is not cut. The pieces are then encoded in parallel, and
their ids joined in order. Decoding concatenates the ids' raw bytes.

Defined cases: a null text is encoded as empty (no ids); a text of one endless word is one piece; equal rows are encoded
alike; a null doc_id is kept; an empty table gives no rows; further columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trefoil.llm import common as C

CHUNK = 50_000
OVERLAP = 2_000


class Vocabulary:
    """Ranks and pattern of one tokenizer; the file's text (about a megabyte) travels in a broadcast, not its path."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            self.shared, self.pattern = spark.sparkContext.broadcast(file.read()), pattern

    def __call__(self) -> tiktoken.Encoding:
        return _encoding(self.shared.value, self.pattern)


@lru_cache(maxsize=2)
def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def edges(text: str, pattern: Any, first: int, last: int) -> tuple[list[int], list[int]]:
    """Safe boundaries (white space after another character) among the token ends of ``text``, below ``first`` and
    from ``last`` on. The last match may be cut short and doesn't count."""
    head, tail = [], []
    for m in pattern.finditer(text):
        at = m.end()
        if at >= len(text):
            break
        if (at < first or at >= last) and text[at].isspace() and not text[at - 1].isspace():
            if at < first:
                head.append(at)
            if at >= last:
                tail.append(at)
    return head, tail


def chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``_row, _n, _from, piece``: the overlapping chunks of each text."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(chunk))
    cut = docs.select("_row", "text", F.posexplode(starts).alias("_n", "_from"))
    return cut.select("_row", "_n", "_from", F.substring("text", F.col("_from") + 1, F.lit(chunk + overlap)).alias("piece"))


def stitches(cut: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``_row, _cut``: the places at which texts are cut, from the boundaries on which neighbouring chunks agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = regex.compile(pattern)
        for batch in batches:
            found = [edges(p, rule, overlap, chunk) for p in batch.column("piece").to_pylist()]
            at = batch.column("_from").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), batch.column("_n"), pa.array([[a + x for x in h] for a, (h, _) in zip(at, found)], pa.list_(pa.int32())),
                pa.array([[a + x for x in t] for a, (_, t) in zip(at, found)], pa.list_(pa.int32())),
            ], ["_row", "_n", "head", "tail"])

    found = cut.mapInArrow(run, "_row string, _n int, head array<int>, tail array<int>")
    following = Window.partitionBy("_row").orderBy("_n")  # the chunks of one text
    both = found.withColumn("next", F.lead("head").over(following))
    return both.select("_row", F.array_min(F.array_intersect("tail", "next")).alias("_cut")).where("_cut is not null")


def _encoded(encoding: tiktoken.Encoding, text: str, with_ids: bool) -> tuple:
    """A text's ids, or their number and digests; a batch never holds more than one text's list of ids."""
    ids = encoding.encode_ordinary(text)
    raw = np.asarray(ids, "<u4").tobytes()
    return (raw,) if with_ids else (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())


def _encode_rows(vocabulary: Vocabulary, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary()
        for batch in batches:
            rows = [_encoded(encoding, t.as_py() or "", with_ids) for t in batch.column("text")]
            kinds = [pa.binary()] if with_ids else [pa.int64(), pa.string(), pa.string()]
            out = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], [*kept, *(["ids"] if with_ids else DIGEST)])

    return run


DIGEST = ["n_tokens", "ids_sha256", "decoded_sha256"]


def encode(docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit integers) of every row."""
    short, long = _split(docs, chunk, overlap)
    done = short.mapInArrow(_encode_rows(vocabulary, True), "doc_id long, ids binary")
    return done.unionByName(_encode_long(long, vocabulary, chunk, overlap))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ``bytes``: the raw bytes of the ids, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary()
        for batch in batches:
            raw = [encoding.decode_bytes(np.frombuffer(i, "<u4").tolist()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the bytes decoded from them."""
    short, long = _split(docs, chunk, overlap)
    done = short.mapInArrow(_encode_rows(vocabulary, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary()
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            back = [hashlib.sha256(encoding.decode_bytes(np.frombuffer(r, "<u4").tolist())).hexdigest() for r in raw]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(r) // 4 for r in raw], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(back),
            ], ["doc_id", *DIGEST])

    joined = _encode_long(long, vocabulary, chunk, overlap).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.unionByName(joined)


def _split(docs: DataFrame, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of(docs).alias("text"))
    one = F.char_length("text") <= chunk + overlap
    return rows.where(one), rows.where(~one)


def _encode_long(rows: DataFrame, vocabulary: Vocabulary, chunk: int, overlap: int) -> DataFrame:
    """A long text's row is named by its doc_id and content; equal rows are encoded once and told apart at the end."""
    n = C.partitions(rows.sparkSession)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256))
    whole = rows.groupBy("doc_id", name.alias("_row"), "text").agg(F.count("*").alias("_times"))
    cut = chunks(whole, chunk, overlap).repartition(n, "_row", "_n")
    at = stitches(cut, vocabulary.pattern, chunk, overlap).groupBy("_row").agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
    marked = whole.join(at, "_row", "left")
    bounds = F.concat(F.array(F.lit(0)), F.coalesce("_cuts", F.array().cast("array<int>")))
    spans = F.transform(bounds, lambda a, i: F.struct(a.alias("a"), F.get(bounds, i + 1).alias("b")))
    pieces = marked.select("_row", "doc_id", "_times", "text", F.posexplode(spans).alias("_n", "s")).select(
        "_row", "doc_id", "_times", "_n",
        F.expr("substring(text, s.a + 1, coalesce(s.b, char_length(text)) - s.a)").alias("text"))
    done = pieces.repartition(n, "_row", "_n").mapInArrow(
        _encode_rows(vocabulary, True), "_row string, doc_id long, _times long, _n int, ids binary")
    joined = done.groupBy("_row", "doc_id", "_times").agg(F.sort_array(F.collect_list(F.struct("_n", "ids"))).alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    times = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    return joined.select("doc_id", ids.alias("ids"), times.alias("_time")).drop("_time")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.documents(spark, sf_dir), Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")))
