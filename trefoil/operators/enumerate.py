"""Listing of connected induced subgraphs by repeated joins; the small-graph check of the counts.

Its rows are the subgraphs themselves, so it grows far faster than the counting job; use it to
look at subgraphs or to verify, not to count in large graphs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trefoil.functions import patterns
from trefoil.operators.graph import both_ways, degrees
from trefoil.session import written

#: Rows that one node may make in a task before its sets are dealt over more.
TASK_ROWS = 2_000_000


@lru_cache(maxsize=None)
def taxonomy(k: int) -> list[tuple[int, int, list[int]]]:
    """(mask, graphlet, orbit of each position) of every connected labelled graph on k nodes.

    Bit b of a mask is the b-th pair of positions in lexicographic order.
    """
    canon: dict[frozenset, tuple[int, list[int]]] = {}
    for g, (text, orbits) in patterns.GRAPHLETS.items():
        if len(orbits) == k:
            for p in permutations(range(k)):
                edges = frozenset(frozenset((p[a], p[b])) for a, b in patterns.parse(text))
                placed = [0] * k
                for node, o in enumerate(orbits):
                    placed[p[node]] = o
                canon[edges] = (g, placed)
    pairs = list(combinations(range(k), 2))
    out = []
    for mask in range(1 << len(pairs)):
        edges = frozenset(frozenset(p) for b, p in enumerate(pairs) if mask >> b & 1)
        if edges in canon:
            out.append((mask, *canon[edges]))
    return out


def _bit(i: int, j: int) -> int:
    """The bit of positions i < j in masks of growing sets: that of an earlier pair doesn't depend on the size."""
    return j * (j - 1) // 2 + i


@lru_cache(maxsize=None)
def _shapes(k: int) -> list[tuple[int, int, list[int], int]]:
    """(mask by ``_bit``, graphlet, orbits, free) of every connected labelled graph; ``free`` has a bit for each position
    without which the others still connect."""
    pairs = list(combinations(range(k), 2))

    def joined(left: list[int], edges: list[tuple[int, int]]) -> bool:
        seen, todo = {left[0]}, [left[0]]
        while todo:
            at = todo.pop()
            new = {p for e in edges if at in e for p in e if p in left} - seen
            seen |= new
            todo += new
        return len(seen) == len(left)

    out = []
    for mask, g, orbits in taxonomy(k):
        edges = [e for b, e in enumerate(pairs) if mask >> b & 1]
        free = sum(1 << p for p in range(k) if joined([q for q in range(k) if q != p], edges))
        out.append((sum(1 << _bit(*e) for e in edges), g, orbits, free))
    return out


def _free(names: list[str]) -> list[Column]:
    """The nodes at free positions, null at others."""
    return [F.when(F.col("free").bitwiseAND(F.lit(1 << p)) != 0, F.col(c)) for p, c in enumerate(names)]


def _shaped(sets: DataFrame, k: int) -> DataFrame:
    """``sets`` with graphlet, orbits and free of their masks."""
    known = sets.sparkSession.createDataFrame(_shapes(k), "mask int, graphlet int, orbits array<int>, free int")
    return sets.join(F.broadcast(known), "mask")  # at most 1024 rows


def _grown(edges: DataFrame, k: int, task_rows: int) -> DataFrame:
    """``n0, n1, ..., mask``: every connected set of k nodes once, with the edges among them.

    A set is grown by its largest node without which the others connect; growing it by any other is dropped, partly before the
    shuffle. A node that would make more than ``task_rows`` rows is dealt over chunks of the sets that it is in."""
    spark = edges.sparkSession
    links = both_ways(edges)
    degree = degrees(edges).withColumnRenamed("v", "u")
    sets = edges.select(F.col("x").alias("n0"), F.col("y").alias("n1"), F.lit(1).alias("mask"))
    for size in range(2, k):
        names = [f"n{i}" for i in range(size)]
        over = F.sort_array(F.array(*_free(names)), asc=False)[1]
        sets = written(_shaped(sets, size).select(*names, "mask", over.alias("over")))
        at_node = sets.select("*", F.posexplode(F.array(*names)).alias("at", "u"))
        made = written(at_node.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(degree, "u").select(
            "u", (F.col("n") * F.col("degree")).alias("rows")))
        total = made.agg(F.sum("rows")).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_rows))
        # No more of them than total / task_rows.
        hubs = F.broadcast(made.filter(F.col("rows") > task_rows).select("u", F.ceil(F.col("rows") / F.lit(task_rows)).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        left = at_node.join(hubs, "u", "left").withColumn("_chunk", F.pmod(F.xxhash64(*names), parts).cast("int")).drop("parts")
        right = links.join(hubs, "u", "left").withColumn("_chunk", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        met = left.repartition(n, "u", "_chunk").join(right.repartition(n, "u", "_chunk"), ["u", "_chunk"])
        met = met.filter((F.col("v") > F.col("over")) & ~F.col("v").isin(*[F.col(c) for c in names]))
        bit = F.expr(f"shiftleft(1, at + {_bit(0, size)})")
        # Dealt by the number of rows, as it is only known here.
        sets = met.repartition(n, *names, "v").groupBy(*names, "mask", "v").agg(F.sum(bit).cast("int").alias("more"))
        sets = _shaped(sets.select(*names, F.col("v").alias(f"n{size}"), (F.col("mask") + F.col("more")).alias("mask")), size + 1)
        names.append(f"n{size}")
        sets = sets.filter(F.col(f"n{size}") == F.greatest(*_free(names))).select(*names, "mask")
    return sets


def connected_subsets(edges: DataFrame, k: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``m``: sorted ids of every connected set of k nodes, each once."""
    return _grown(edges, k, task_rows).select(F.array_sort(F.array(*[f"n{i}" for i in range(k)])).alias("m"))


def classified_subsets(edges: DataFrame, k: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``m, graphlet, orbits``: every connected set of k nodes with its graphlet and orbits."""
    sets = _shaped(_grown(edges, k, task_rows), k)
    placed = F.array_sort(F.arrays_zip(F.array(*[f"n{i}" for i in range(k)]).alias("v"), F.col("orbits").alias("o")))
    return sets.select("graphlet", placed.alias("z")).select(F.col("z.v").alias("m"), "graphlet", F.col("z.o").alias("orbits"))


def enumerated_node_orbits(edges: DataFrame, nodes: DataFrame, size: int = 4) -> DataFrame:
    """``v, o0..`` like the counting job, by classifying every subgraph."""
    total = nodes.select("v", F.lit(None).cast("int").alias("orbit"))
    total = total.unionByName(both_ways(edges).select(F.col("u").alias("v"), F.lit(0).alias("orbit")))
    for k in range(3, size + 1):
        placed = F.explode(F.array(*[
            F.struct(F.col(f"n{i}").alias("v"), F.col("orbits")[i].alias("orbit")) for i in range(k)])).alias("z")
        total = total.unionByName(_shaped(_grown(edges, k, TASK_ROWS), k).select(placed).select("z.v", "z.orbit"))
    counted = total.groupBy("v", "orbit").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("v").agg(*[
        F.coalesce(F.sum(F.when(F.col("orbit") == o, F.col("n"))), F.lit(0)).alias(f"o{o}")
        for o in range(patterns.N_NODE_ORBITS[size])
    ])
