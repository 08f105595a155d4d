"""Neighbour descent: neighbours of neighbours, round by round, until few lists change.

A round samples from every row's list its new and its old neighbours and, from all rows that list it, new and old
ones in turn; rows that meet in such a sample and of which one is new are compared, and pairs that beat a list's last
entry enter it as new. Samples are at most ``sample`` entries a kind and direction, so a round compares at most
n x 8 sample^2 pairs; reverse lists of hubs are sampled part by part before they are gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trefoil.operators import neighbors as N
from trefoil.session import cut_lineage, written

#: Parts in which a hub's reverse list is sampled first.
PARTS = 64


def _sampled(lists: DataFrame, sample: int, seed: int) -> DataFrame:
    """At most ``sample`` rows of each (v, fresh, way), by a hash; crowded groups are thinned part by part first."""
    turn = F.xxhash64("v", "u", F.lit(seed))
    part = F.pmod(F.xxhash64("u", F.lit(seed)), F.lit(PARTS))
    thin = Window.partitionBy("v", "fresh", "way", "part").orderBy("turn", "u")
    whole = Window.partitionBy("v", "fresh", "way").orderBy("turn", "u")
    rows = lists.withColumns({"turn": turn, "part": part})
    rows = rows.withColumn("r", F.row_number().over(thin)).filter(F.col("r") <= sample)
    return rows.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= sample).drop("r", "turn", "part")


def descend(start: DataFrame, rows: DataFrame, k: int, space: N.Space, sample: int = 10, rounds: int = 12,
            change: float = 0.001, seed: int = 0) -> tuple[DataFrame, list[int]]:
    """Better lists ``i, j, d, rk`` from ``start`` (``i, j, d``), over prepared ``rows`` (``id, features``), and the entries changed
    in each round. It stops when fewer than ``change`` of all n k entries did."""
    fn = space.fn
    best = cut_lineage(N._merge(start.select("i", "j", "d"), k).withColumn("fresh", F.lit(True)))
    n, changed = rows.count(), []
    for round_ in range(rounds):
        forward = best.select(F.col("i").alias("v"), F.col("j").alias("u"), "fresh", F.lit(0).alias("way"))
        backward = best.select(F.col("j").alias("v"), F.col("i").alias("u"), "fresh", F.lit(1).alias("way"))
        taken = cut_lineage(_sampled(forward.unionByName(backward), sample, seed + round_))
        met = taken.groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        last = best.groupBy("i").agg(F.when(F.count(F.lit(1)) < k, F.lit(float("inf"))).otherwise(F.max("d")).alias("limit"))
        about = rows.join(last, rows["id"] == last["i"], "left").select(
            F.col("id").alias("u"), "features", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
        entry = F.struct("u", "fresh", "limit", "features")
        groups = met.join(about, "u").groupBy("v").agg(F.collect_list(entry).alias("members"))  # 4 x sample at most

        def compare(batches):
            for pdf in batches:
                out = []
                for members in pdf["members"]:
                    fresh = np.array([m["fresh"] for m in members])
                    if len(members) < 2 or not fresh.any():
                        continue
                    u, limit = np.array([m["u"] for m in members]), np.array([m["limit"] for m in members])
                    x = np.stack([m["features"] for m in members]).astype(float)
                    d = np.asarray(fn(x[:, None, :], x[None]), float)
                    a, b = np.nonzero((fresh[:, None] | fresh[None]) & (d < limit[:, None]) & (u[:, None] != u[None]))
                    out.append(pd.DataFrame({"i": u[a], "j": u[b], "d": d[a, b]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

        fresh = groups.select("members").mapInPandas(compare, "i long, j long, d double").dropDuplicates(["i", "j"])
        fresh = fresh.join(best.select("i", "j"), ["i", "j"], "left_anti").withColumn("fresh", F.lit(True))
        used = taken.filter("way = 0 AND fresh").select(F.col("v").alias("i"), F.col("u").alias("j"), F.lit(True).alias("used"))
        kept = best.join(used, ["i", "j"], "left").select("i", "j", "d", (F.col("fresh") & F.col("used").isNull()).alias("fresh"))
        order = Window.partitionBy("i").orderBy("d", "j")
        both = kept.withColumn("came", F.lit(0)).unionByName(fresh.withColumn("came", F.lit(1)))
        merged = written(both.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k))
        changed.append(merged.filter("came = 1").count())
        best = merged.drop("came")
        if changed[-1] <= change * n * k:
            break
    return best.select("i", "j", "d", "rk"), changed
