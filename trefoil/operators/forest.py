"""A stored forest of random projection trees: approximate neighbours of its own rows and of new ones.

A cell of a tree is split by the plane half-way between two of its rows. Cells of more than ``TASK_ROWS`` rows are split
level by level in Spark (the two rows come from one grouped aggregate, the rows meet their plane in a join); smaller ones are
finished in one task each. Rows that no plane tells apart are halved by hash, so that every leaf keeps its size.

The index is three tables: ``top`` planes by level, ``planes`` below them by cell, and ``leaves`` with the rows. A new row walks
the planes, keeps the few leaves it came closest to, and meets only their rows: its work does not depend on
the number of rows, but for the few levels on top.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trefoil.operators import neighbors as N
from trefoil.session import cut_lineage

TASK_ROWS = 20_000
LEAF_ROWS = 64
#: Queries that meet one leaf in one task.
QUERY_ROWS = 2048
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"


def _halves(x: np.ndarray, rng: np.random.Generator, least: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Which rows are on the upper side of a plane between two of them, its normal and offset. A lopsided plane moves
    to the median; equal rows are halved at random, with a normal of zero."""
    for _ in range(4):
        a, b = x[rng.choice(len(x), 2, replace=False)]
        normal = a - b
        if normal.any():
            break
    if not normal.any():
        differ = np.flatnonzero((x != x[0]).any(1))
        normal = x[differ[0]] - x[0] if len(differ) else normal
        a, b = (x[differ[0]], x[0]) if len(differ) else (a, b)
    at = x @ normal
    offset = float(normal @ (a + b) / 2)
    upper = at > offset
    if min(upper.sum(), (~upper).sum()) < least:
        offset = float(np.median(at))
        upper = at > offset
        short = len(x) // 2 - int(upper.sum())
        if short > 0:  # many rows lie on the plane
            on = np.flatnonzero(at == offset)
            upper[rng.permutation(on)[:short]] = True
    return upper, normal, offset


def _grow(x: np.ndarray, leaf_rows: int, least: int, rng: np.random.Generator):
    """Leaf number of every row, and the planes (node, lower child, upper child, normal, offset); leaves are children below zero:
    leaf n is -1 - n. Node 0 is the root, if there is a plane at all."""
    leaf, planes, leaves = np.zeros(len(x), np.int64), [], 0
    todo, nodes = [(np.arange(len(x)), None)], 0
    while todo:
        rows, mother = todo.pop()
        if len(rows) <= leaf_rows:
            leaf[rows], name = leaves, -1 - leaves
            leaves += 1
        else:
            upper, normal, offset = _halves(x[rows], rng, least)
            name = nodes
            nodes += 1
            planes.append([name, 0, 0, normal, offset])
            todo += [(rows[~upper], (name, 1)), (rows[upper], (name, 2))]
        if mother is not None:
            planes[mother[0]][mother[1]] = name
    return leaf, planes


def _closest_leaves(x: np.ndarray, planes: pd.DataFrame, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs: for each query the ``probes`` leaves with the smallest step across a plane on the way."""
    query, node, cost = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    if not len(planes):
        return query, node  # a single leaf, number 0
    planes = planes.sort_values("node")
    child = planes[["low", "high"]].to_numpy(np.int64)
    normal = np.stack(planes["features"].to_numpy())
    length = np.sqrt((normal * normal).sum(1))
    offset = planes["offset"].to_numpy(float)
    while (node >= 0).any():
        open_ = node >= 0
        q, n, c = query[open_], node[open_], cost[open_]
        margin = ((x[q] * normal[n]).sum(1) - offset[n]) / np.maximum(length[n], 1e-300)
        parts = [(query[~open_], node[~open_], cost[~open_])]
        for side, away in ((1, -margin), (0, margin)):
            parts.append((q, child[n, side], np.maximum(c, np.maximum(away, 0.0))))
        query, node, cost = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((node, cost, query))
        query, node, cost = query[order], node[order], cost[order]
        first = np.r_[True, query[1:] != query[:-1]]
        rank = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        query, node, cost = query[rank < probes], node[rank < probes], cost[rank < probes]
    return query, -1 - node


@dataclass(frozen=True)
class Forest:
    """``top``: level, tree, cell, features (normal), offset; ``planes``: tree, cell, node, low, high, features, offset;
    ``leaves``: tree, cell, leaf, id, features. Features are prepared for the metric."""

    space: N.Space
    trees: int
    levels: int
    n: int
    top: DataFrame | None
    planes: DataFrame
    leaves: DataFrame

    @staticmethod
    def build(points: DataFrame, metric="euclidean", params: dict | None = None, trees: int = 8, leaf_rows: int = LEAF_ROWS,
              k: int = 10, seed: int = 0, task_rows: int | None = None) -> "Forest":
        """``trees`` trees whose leaves hold at most ``leaf_rows`` rows (2 k + 2 at least)."""
        space = N.space_of(metric, N._from_data(points, metric, params))
        rows = N._prepare(points, space)
        leaf_rows, least, limit = max(leaf_rows, 2 * k + 2), k + 1, task_rows or TASK_ROWS
        each = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
        placed = cut_lineage(rows.withColumn("tree", each).withColumn("cell", F.lit(1).cast("long")))
        n, top, level = placed.filter("tree = 0").count(), [], 0
        while True:
            turn = F.xxhash64("id", "tree", "cell", F.lit(seed))
            crowd = placed.groupBy("tree", "cell").agg(
                F.count(F.lit(1)).alias("n"), F.min_by("features", turn).alias("a"), F.max_by("features", turn).alias("b"),
            ).filter(F.col("n") > limit)
            normal = F.zip_with("a", "b", lambda x, y: x - y)
            middle = F.zip_with("a", "b", lambda x, y: (x + y) / 2)
            crowd = crowd.withColumns({"normal": normal, "middle": middle}).withColumn("offset", F.expr(_DOT.format(a="normal", b="middle")))
            crowd = cut_lineage(crowd.select("tree", "cell", "normal", "offset"))
            if crowd.isEmpty():
                break
            placed = cut_lineage(_step(placed.join(crowd, ["tree", "cell"], "left"), seed).select(*placed.columns))
            top.append(crowd.withColumn("level", F.lit(level)))
            level += 1
        kind = "tree int, cell long, leaf long, id long, features array<double>, node long, low long, high long, offset double"
        columns = [c.split()[0] for c in kind.split(", ")]

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable")
            tree, cell = int(pdf["tree"].iloc[0]), int(pdf["cell"].iloc[0])
            leaf, planes = _grow(N._stack(pdf["features"]), leaf_rows, least, np.random.default_rng([seed, tree, cell % (1 << 32)]))
            out = pd.DataFrame({"leaf": leaf, "id": pdf["id"].to_numpy(), "features": pdf["features"].to_numpy()})
            if planes:
                cut = pd.DataFrame(planes, columns=["node", "low", "high", "features", "offset"])
                out = pd.concat([out, cut], ignore_index=True)
            return out.assign(tree=tree, cell=cell).astype({c: "Int64" for c in ("leaf", "id", "node", "low", "high") if c in out}).reindex(columns=columns)

        grown = cut_lineage(placed.groupBy("tree", "cell").applyInPandas(finish, kind))
        joined = None
        for one in top:
            joined = one if joined is None else joined.unionByName(one)
        return Forest(
            space, trees, level, n, joined, grown.filter("leaf IS NULL").drop("leaf", "id"),
            grown.filter("leaf IS NOT NULL").select("tree", "cell", "leaf", "id", "features"))

    def own(self, k: int) -> DataFrame:
        """``i, j, d, rk``: neighbours of the forest's rows among those they share a leaf with."""
        if k < 1 or k > self.n - 1:
            raise ValueError(f"k={k} does not fit {self.n} rows")
        keys = ["tree", "cell", "leaf"]
        side = self.leaves.select("id", "features", *keys)
        return self._best(N._meet(side, side, keys, k, self.space, True), k)

    def query(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """``i, j, d, rk``: for each query its k nearest rows in the ``probes`` closest leaves of every tree."""
        if k < 1 or k > self.n:
            raise ValueError(f"k={k} does not fit {self.n} rows")
        rows = N._prepare(queries, self.space)
        at = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1)))).withColumn("cell", F.lit(1).cast("long"))
        for level in range(self.levels):
            here = self.top.filter(F.col("level") == level).drop("level")
            at = _step(at.join(here, ["tree", "cell"], "left"), 0).select(*at.columns)
        at = cut_lineage(at)
        group = ["tree", "cell"]
        crowd = at.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).alias("parts"))
        at = at.join(crowd, group).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
        planes = self.planes.join(crowd, group).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

        def route(q: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
            if not len(q):
                return pd.DataFrame({"id": [], "features": [], "tree": [], "cell": [], "leaf": []})
            query, leaf = _closest_leaves(N._stack(q["features"]), cut, probes)
            return q.iloc[query][["id", "features", "tree", "cell"]].assign(leaf=leaf)

        found = at.groupBy(*group, "part").cogroup(planes.groupBy(*group, "part")).applyInPandas(
            route, "id long, features array<double>, tree int, cell long, leaf long")
        found = cut_lineage(found)
        keys = ["tree", "cell", "leaf"]
        busy = found.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).alias("parts"))
        left = found.join(busy, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
        right = self.leaves.join(busy, keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        columns = ["id", "features", *keys, "part"]
        return self._best(N._meet(left.select(*columns), right.select(*columns), [*keys, "part"], k, self.space, False), k)

    def _best(self, hits: DataFrame, k: int) -> DataFrame:
        best = N._merge(hits.groupBy("i", "j").agg(F.min("d").alias("d")), k)
        if self.space.finish is not None:
            best = best.withColumn("d", self.space.finish(F.col("d")))
        return best.select("i", "j", "d", "rk")


def _step(joined: DataFrame, seed: int) -> DataFrame:
    """Rows with a plane (``normal, offset``) move to the cell of their side; a zero normal halves by hash."""
    flat = F.forall("normal", lambda x: x == 0)
    upper = F.expr(_DOT.format(a="features", b="normal")) > F.col("offset")
    side: Column = F.when(flat, F.pmod(F.xxhash64("id", "cell", F.lit(seed)), F.lit(2)) == 1).otherwise(upper)
    return joined.withColumn("cell", F.when(F.col("normal").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", side)))
