"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VNODES`` points of the ring; a document belongs to the first point clockwise of its text's hash, so
equal texts stand at one place. A shard takes at most its quota of rows (N div shards, and one more for the first
N mod shards): first those of its own arcs, then what full shards could not take, which walks on clockwise. All quotas
sum to N, so row counts differ by one at most, and only overflowing rows stand away from their own shard.

The walk needs the number of rows per arc only (shards x VNODES of them); a row's shard and slot then follow from its
place in the global ring order. Defined cases: a null text is hashed as empty and has size 1; repeated rows are
placed one by one; a null doc_id sorts first; an empty table gives no rows; further columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.llm import common as C

SHARDS = 8
VNODES = 64


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Sorted ring points and the shard of each; shards x vnodes rows by definition."""
    points = spark.range(shards * vnodes).select(
        (F.col("id") % shards).alias("shard"), F.xxhash64(F.lit("vnode"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at"))
    rows = sorted((r["at"], r["shard"]) for r in points.collect())
    return [r[0] for r in rows], [r[1] for r in rows]


def fill(counts: list[int], owners: list[int], quotas: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces ``(arc, first, end, shard)`` of the arcs' rows. A shard's own arcs come first, in ring order; then the
    overflow of each arc walks clockwise to the next shard with room."""
    room, pieces, over = list(quotas), [], []
    for arc, n in enumerate(counts):
        took = min(n, room[owners[arc]])
        if took:
            pieces.append((arc, 0, took, owners[arc]))
            room[owners[arc]] -= took
        if n > took:
            over.append((arc, took, n))
    for arc, at, end in over:
        step = arc
        while at < end:
            step = (step + 1) % len(owners)
            took = min(end - at, room[owners[step]])
            if took:
                pieces.append((arc, at, at + took, owners[step]))
                room[owners[step]] -= took
                at += took
    return pieces


def place(rows: DataFrame, key: Column, order: list, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; ``key`` is the ring hash (long), ``order`` breaks ties within it."""
    spark = rows.sparkSession
    points, owners = ring_points(spark, shards, vnodes)
    # An arc ends at its point; beyond the last point the ring starts anew.
    arc = C.search(points, key - 1) % len(points)
    placed = C.global_index(rows.withColumns({"_arc": arc, "_key": key}), ["_arc", "_key", *order], "ring")
    found = {r["_arc"]: r["n"] for r in placed.groupBy("_arc").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(a, 0) for a in range(len(points))]
    total = sum(counts)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    starts = [sum(counts[:a]) for a in range(len(counts))]
    slots, table = [0] * shards, []
    for a, first, end, shard in sorted(fill(counts, owners, quotas)):
        table.append((a, starts[a] + first, starts[a] + end, shard, slots[shard] - starts[a] - first))
        slots[shard] += end - first
    pieces = C.rows_of(spark, table, "_arc int, _from bigint, _to bigint, shard int, _shift bigint")
    on = [placed["_arc"] == pieces["_arc"], placed["_rank"] >= pieces["_from"], placed["_rank"] < pieces["_to"]]
    out = placed.join(F.broadcast(pieces), on).withColumn("slot", F.col("_rank") + F.col("_shift"))
    return out.select(*rows.columns, "shard", "slot")


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    text = C.text_of(docs)
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"))
    placed = place(rows, F.col("_hash"), ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
