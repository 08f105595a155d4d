"""Undirected graph building blocks: clean edges, degrees, triangles, cliques, codegrees.

Cliques are listed along a degree order (each edge points to its higher-degree end, ties by id), so
a node's out-list holds at most sqrt(2m) ids however large a hub is, and only real cliques become
rows. Joins on an end that a hub may dominate are cut: lookups of degrees broadcast the hubs, of which no more than
BROADCAST_ROWS can exist at their degree, and triangles and wedges deal a hub's edges over chunks, so a hub's rows are spread
over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.session import BROADCAST_ROWS, cut_lineage, written

# Edges of one centre that one join key may hold before it is split further.
HUB_CHUNK = 4096
# Walks of two edges that a task counts at once.
TASK_WALKS = 1 << 21


def clean_edges(raw: DataFrame, n_nodes: int | None = None, strict: bool = False) -> DataFrame:
    """Distinct undirected edges ``edge_id, x, y`` with x < y.

    Lenient reading drops self loops and repeats; ``strict`` makes them errors. Ids below 0 or at
    least ``n_nodes`` are errors either way.
    """
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    bad = src.isNull() | dst.isNull() | (src < 0) | (dst < 0)
    if n_nodes is not None:
        bad = bad | (src >= n_nodes) | (dst >= n_nodes)
    if strict:
        bad_loop = src == dst
    else:
        raw, bad_loop = raw.filter(src != dst), F.lit(False)
    order = F.col("edge_id").cast("long") if "edge_id" in raw.columns else F.lit(None).cast("long")
    checked = raw.select(
        order.alias("edge_id"),
        F.when(bad, F.raise_error(F.lit("node id out of range")).cast("long"))
        .when(bad_loop, F.raise_error(F.lit("self loop")).cast("long"))
        .otherwise(F.least(src, dst))
        .alias("x"),
        F.greatest(src, dst).alias("y"),
    )
    merged = checked.groupBy("x", "y").agg(
        F.min("edge_id").alias("edge_id"), F.count(F.lit(1)).alias("_copies")
    )
    if strict:
        merged = merged.withColumn(
            "x",
            F.when(F.col("_copies") > 1, F.raise_error(F.lit("duplicate edge")).cast("long")).otherwise(
                F.col("x")
            ),
        )
    return merged.select("edge_id", "x", "y")


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """Each undirected edge as ``u, v`` and ``v, u`` rows."""
    there = edges.select(F.col("x").alias("u"), F.col("y").alias("v"), *carry)
    back = edges.select(F.col("y").alias("u"), F.col("x").alias("v"), *carry)
    return there.unionByName(back)


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``v, degree``; with ``nodes(v)`` isolated nodes appear with 0."""
    counted = both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    counted = counted.withColumnRenamed("u", "v")
    if nodes is None:
        return counted
    return nodes.select("v").join(counted, "v", "left").fillna(0, subset=["degree"])


def degree_histogram(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return degrees(edges, nodes).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def with_degrees(edges: DataFrame) -> DataFrame:
    """Add the degrees of both ends as ``dx, dy``.

    Hubs are nodes above a degree that at most ``BROADCAST_ROWS`` nodes can exceed, as all degrees sum to 2m. Their edges
    meet a broadcast of them; only edges of other nodes are shuffled by that end.
    """
    deg = cut_lineage(degrees(edges))
    ends = deg.agg(F.sum("degree")).first()[0] or 0
    floor = max(HUB_CHUNK, -(-ends // BROADCAST_ROWS))
    light, hubs = deg.filter(F.col("degree") <= floor), deg.filter(F.col("degree") > floor)
    some = not hubs.isEmpty()
    for end, name in (("x", "dx"), ("y", "dy")):
        found = edges
        if some:
            found = edges.join(F.broadcast(hubs.select(F.col("v").alias(end))), end, "left_anti")
        found = found.join(light.toDF(end, name), end)
        edges = found.unionByName(edges.join(F.broadcast(hubs.toDF(end, name)), end)) if some else found
    return edges


def oriented(edges_with_degrees: DataFrame) -> DataFrame:
    """``a, b`` with (degree, id) of a below that of b, and their degrees ``da, db``."""
    flip = (F.col("dx") > F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") > F.col("y")))
    return edges_with_degrees.select(
        F.when(flip, F.col("y")).otherwise(F.col("x")).alias("a"),
        F.when(flip, F.col("x")).otherwise(F.col("y")).alias("b"),
        F.least("dx", "dy").alias("da"), F.greatest("dx", "dy").alias("db"),
    )


def out_lists(arcs: DataFrame) -> DataFrame:
    """``a, da, out``: sorted higher neighbours, at most sqrt(2m) of them, and the degree of a."""
    return arcs.groupBy("a").agg(F.max("da").alias("da"), F.sort_array(F.collect_list("b")).alias("out"))


def triangle_list(arcs: DataFrame, outs: DataFrame, chunk: int = HUB_CHUNK) -> DataFrame:
    """Each triangle once as ``a, b, c`` with ``both``, the higher common neighbours of a and b.

    The arcs into a hub b are dealt over chunks, and its list is repeated once a chunk.
    """
    heads = outs.select(F.col("a").alias("b"), F.col("da").alias("db"), F.col("out").alias("out_b"))
    tails = arcs.select("a", "b", "db").join(outs.select("a", "out"), "a")
    return (
        chunked_join(tails, heads, "b", "db", chunk, ["a"])
        .withColumn("both", F.array_intersect("out", "out_b"))
        .filter(F.size("both") > 0)
        .select("a", "b", "both", F.explode("both").alias("c"))
    )


def clique4_list(triangles: DataFrame, outs: DataFrame) -> DataFrame:
    """Each 4-clique once as ``a, b, c, d`` with ``three``, the nodes closing a, b, c."""
    tails = outs.select(F.col("a").alias("c"), F.col("out").alias("out_c"))
    return (
        triangles.filter(F.size("both") > 1)
        .join(tails, "c")
        .withColumn("three", F.array_intersect("both", "out_c"))
        .filter(F.size("three") > 0)
        .select("a", "b", "c", "three", F.explode("three").alias("d"))
    )


def clique5_list(cliques4: DataFrame, outs: DataFrame) -> DataFrame:
    """Each 5-clique once as ``a, b, c, d, e``."""
    tails = outs.select(F.col("a").alias("d"), F.col("out").alias("out_d"))
    return (
        cliques4.filter(F.size("three") > 1)
        .join(tails, "d")
        .select("a", "b", "c", "d", F.explode(F.array_intersect("three", "out_d")).alias("e"))
    )


def _pairs_of(cols: list[str]) -> list:
    return [
        F.struct(F.least(p, q).alias("x"), F.greatest(p, q).alias("y"))
        for i, p in enumerate(cols)
        for q in cols[i + 1:]
    ]


def edge_membership(cliques: DataFrame, cols: list[str], name: str) -> DataFrame:
    """How many listed cliques hold each edge: ``x, y, name``."""
    return (
        cliques.select(F.explode(F.array(*_pairs_of(cols))).alias("e"))
        .groupBy(F.col("e.x").alias("x"), F.col("e.y").alias("y"))
        .agg(F.count(F.lit(1)).alias(name))
    )


def edge_triangles(edges: DataFrame, chunk: int = HUB_CHUNK) -> DataFrame:
    """``x, y, triangles`` for every edge, 0 included."""
    arcs = oriented(with_degrees(edges))
    listed = triangle_list(arcs, out_lists(arcs), chunk)
    counts = edge_membership(listed, ["a", "b", "c"], "triangles")
    return edges.select("x", "y").join(counts, ["x", "y"], "left").fillna(0, subset=["triangles"])


def node_cliques(edges: DataFrame, size: int, nodes: DataFrame | None = None) -> DataFrame:
    """``v, n_cliques`` for cliques of 3, 4 or 5 nodes."""
    arcs = oriented(with_degrees(edges))
    outs = out_lists(arcs)
    listed, cols = triangle_list(arcs, outs), ["a", "b", "c"]
    if size >= 4:
        listed, cols = clique4_list(listed, outs), cols + ["d"]
    if size == 5:
        listed, cols = clique5_list(listed, outs), cols + ["e"]
    found = (
        listed.select(F.explode(F.array(*cols)).alias("v"))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n_cliques"))
    )
    base = nodes if nodes is not None else both_ways(edges).select(F.col("u").alias("v")).distinct()
    return base.select("v").join(found, "v", "left").fillna(0, subset=["n_cliques"])


def chunked_join(left: DataFrame, right: DataFrame, key: str, degree: str, chunk: int,
                 by: list[str] | None = None) -> DataFrame:
    """Join on ``key`` with the left rows of a big key cut into chunks of about ``chunk`` rows, by a hash of the columns
    ``by`` (all).

    ``degree`` (carried by both sides) is the number of rows of the key; the right rows of a big
    key are repeated once per chunk, those of ordinary keys are not.
    """
    parts = F.greatest(F.ceil(F.col(degree) / F.lit(chunk)), F.lit(1)).cast("int")
    cut = left.withColumn("_chunk", F.pmod(F.xxhash64(*(by or left.columns)), parts).cast("int")).drop(degree)
    repeated = right.withColumn("_chunk", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.join(repeated, [key, "_chunk"]).drop("_chunk")


def wedges(links: DataFrame, left_cols: list[str], right_cols: list[str], chunk: int = HUB_CHUNK) -> DataFrame:
    """Walks u - c - b (b may equal u) as ``u, c, b``.

    ``links`` has ``u, v`` both ways and ``du`` (degree of u); ``left_cols`` come from the (c, u)
    row and ``right_cols`` from the (c, b) row.
    """
    left = links.select(F.col("u").alias("c"), F.col("v").alias("u_"), *left_cols, "du")
    right = links.select(F.col("u").alias("c"), F.col("v").alias("b"), *right_cols, "du")
    return chunked_join(left, right, "c", "du", chunk).withColumnRenamed("u_", "u")


def codegrees(edges: DataFrame, chunk: int = HUB_CHUNK) -> DataFrame:
    """``x, z, codegree`` for each unordered pair of nodes with a common neighbour."""
    two = with_degrees(edges)
    links = two.select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("dx").alias("du")).unionByName(
        two.select(F.col("y").alias("u"), F.col("x").alias("v"), F.col("dy").alias("du"))
    )
    return (
        wedges(links, [], [], chunk)
        .filter(F.col("u") < F.col("b"))
        .groupBy(F.col("u").alias("x"), F.col("b").alias("z"))
        .agg(F.count(F.lit(1)).alias("codegree"))
    )


def edge_squares(edges_with_degrees: DataFrame, chunk: int = HUB_CHUNK, walks: int = TASK_WALKS) -> DataFrame:
    """4-cycles through each edge: ``x, y, squares`` (edges in none are absent).

    Each cycle is found once at its top node in the degree order: the walk top - c - w keeps only
    c and w below the top, so the number of walks is bounded by the sum over edges of the smaller
    degree even when hubs exist. Walks of one top and centre travel as one row, the list of their w; about ``walks`` of them
    are counted in a group, and a top with more is dealt over groups by w.
    """
    two = edges_with_degrees
    links = written(two.select(
        F.col("x").alias("c"), F.col("y").alias("o"), F.col("dx").alias("dc"), F.col("dy").alias("do")
    ).unionByName(
        two.select(
            F.col("y").alias("c"), F.col("x").alias("o"), F.col("dy").alias("dc"), F.col("dx").alias("do")
        )
    ))
    up = (F.col("do") > F.col("dc")) | ((F.col("do") == F.col("dc")) & (F.col("o") > F.col("c")))
    tops = links.filter(up).select("c", F.col("o").alias("top"), F.col("do").alias("dt"), "dc")
    load = tops.groupBy("top").agg(F.sum("dc").alias("load"))
    heavy = cut_lineage(load.filter(F.col("load") > walks).select("top", F.ceil(F.col("load") / F.lit(walks)).cast("int").alias("shares")))
    groups = max(1, -(-(tops.agg(F.sum("dc")).first()[0] or 0) // walks))
    # Ordinary centres hold their neighbours in one sorted list, and what is below a top is the part of it before the top.
    entry = F.struct(F.col("do").alias("d"), F.col("o").alias("v"))
    lists = links.filter(F.col("dc") <= chunk).groupBy("c").agg(F.max("dc").alias("dc"), F.sort_array(F.collect_list(entry)).alias("all"))
    at = lists.select("c", "dc", F.col("all.v").alias("ids"), F.posexplode("all").alias("pos", "to"))
    above = (F.col("to.d") > F.col("dc")) | ((F.col("to.d") == F.col("dc")) & (F.col("to.v") > F.col("c")))
    walked = at.filter(above & (F.col("pos") > 0)).select(
        F.col("to.v").alias("top"), "c", F.lit(0).alias("piece"), F.slice("ids", F.lit(1), F.col("pos")).alias("ws"))
    # A hub's list is cut into pieces, and every top of it meets each.
    piece = F.pmod(F.xxhash64("o"), F.ceil(F.col("dc") / F.lit(chunk))).cast("int").alias("piece")
    pieces = links.filter(F.col("dc") > chunk).groupBy("c", piece).agg(F.collect_list(entry).alias("all"))
    below = F.filter("all", lambda e: e < F.struct(F.col("dt").alias("d"), F.col("top").alias("v")))
    hubs = tops.filter(F.col("dc") > chunk).join(pieces, "c").select("top", "c", "piece", F.transform(below, lambda e: e["v"]).alias("ws"))
    walked = walked.unionByName(hubs.filter(F.size("ws") > 0))
    if not heavy.isEmpty():
        shared = walked.join(F.broadcast(heavy), "top").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        mine = F.filter("ws", lambda w: F.pmod(F.xxhash64(w), F.col("shares")) == F.col("share"))
        shared = shared.select("top", "c", "piece", mine.alias("ws"), "share").filter(F.size("ws") > 0)
        walked = walked.join(F.broadcast(heavy), "top", "left_anti").withColumn("share", F.lit(0)).unionByName(shared)
    else:
        walked = walked.withColumn("share", F.lit(0))
    dealt = walked.select("top", "c", "piece", "ws", F.pmod(F.xxhash64("top", "share"), F.lit(groups)).alias("slot"))
    mates = dealt.groupBy("slot").applyInArrow(_mates, "top long, c long, piece int, n long, ws array<long>, ns array<int>")
    back = mates.select("top", "c", "n", "ws", "ns", F.pmod(F.xxhash64("c", "piece"), F.lit(groups)).alias("slot"))
    return (
        back.groupBy("slot").applyInArrow(_summed, "c long, o long, n long")
        .groupBy(F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"))
        .agg(F.sum("n").alias("squares")).filter(F.col("squares") > 0)
    )


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of lists, one after the other, and the length of each."""
    return pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy()


def _mates(rows: pa.Table) -> pa.Table:
    """For every walk how many other centres its top and end share (``ns``), and their sum for the edge of top and centre."""
    ends, size = _flat(rows["ws"])
    top, _ = pd.factorize(rows["top"].to_numpy())
    w, names = pd.factorize(ends)
    pair, _ = pd.factorize(np.repeat(top.astype(np.int64), size) * len(names) + w)
    n = np.bincount(pair)[pair] - 1
    starts = np.concatenate([[0], np.cumsum(size)])
    total = np.add.reduceat(n, starts[:-1])  # no list is empty
    some = total > 0
    return pa.table({
        "top": rows["top"], "c": rows["c"], "piece": rows["piece"], "n": total.astype(np.int64),
        "ws": rows["ws"].combine_chunks(), "ns": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(n, pa.int32())),
    }).filter(pa.array(some))


def _summed(rows: pa.Table) -> pa.Table:
    """The squares of every edge of a centre, with the end of a walk or its top."""
    (ends, size), (n, _) = _flat(rows["ws"]), _flat(rows["ns"])
    c, centres = pd.factorize(rows["c"].to_numpy())
    o, names = pd.factorize(np.concatenate([ends, rows["top"].to_numpy()]))
    edge, keys = pd.factorize(np.concatenate([np.repeat(c, size), c]).astype(np.int64) * len(names) + o)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, edge, np.concatenate([n, rows["n"].to_numpy()]))
    return pa.table({"c": centres[keys // len(names)], "o": names[keys % len(names)], "n": total})
