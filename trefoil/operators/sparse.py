"""Exact neighbours of sparse rows (``id, dim, weight``) through inverted lists, by cosine or Jaccard distance.

Rows that share a dimension meet in the list of that dimension. Two passes keep long lists from meeting themselves:

1. Over rare dimensions (lists of at most ``RARE`` rows) partial sums give lower bounds of similarities, and the k-th
   best bound of a row is a similarity that its neighbours reach.
2. A row's dimensions are ordered from rare to frequent. A suffix of them whose norm (Jaccard: share of its dimensions)
   is below that bound can't reach it alone, so the row asks only the lists before it. Pairs whose partial sum and suffix
   still don't reach the bound go; for the rest the suffix is added through a join on (row, dimension).

Rows whose dimensions are all rare are done after the first pass. In both, whole lists travel to the rows that ask them, packed in bits
without loss (``functions.lists``), and are opened and added up there in Arrow batches, so pairs are never shuffled.

Lists above ``CHUNK`` rows are dealt over chunks and the rows that ask them are repeated once a chunk. Nothing is broadcast but
the 2k smallest ids, which fill up rows with fewer than k others that share a dimension with them.

Defined cases: weights of a repeated (id, dim) add up; null and zero weights, null ids and null dimensions count as absent; negative
weights are an error, because a partial sum would be no bound then. A row without dimensions (listed in ``ids`` only) is at distance 1
from all. Ties go to the smaller id. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trefoil.functions import lists as L
from trefoil.session import written

RARE = 256
CHUNK = 4096
#: Products that one partition of rows adds up.
PARTITION_PAIRS = 4_000_000
#: Products that a task holds at once, besides the lists of one batch.
PIECE_PAIRS = 500_000
#: Slack of comparisons with a bound, far above the rounding of sums and far below a difference of interest.
SLACK = 1e-9
METRICS = ("cosine", "jaccard")


def _entries(rows: DataFrame, metric: str) -> DataFrame:
    """``id, dim, w, size, df, longest``: summed weights (Jaccard: 1), the row's sum of squares, the length of the dimension's list
    and of the longest list that the row is in."""
    w = F.col("weight").cast("double")
    w = F.when(w < 0, F.raise_error(F.lit("sparse neighbours need weights of 0 or more")).cast("double")).otherwise(w)
    kept = rows.select(F.col("id").cast("long").alias("id"), "dim", w.alias("w"))
    kept = kept.filter("id IS NOT NULL AND dim IS NOT NULL AND w <> 0").groupBy("id", "dim").agg(F.sum("w").alias("w"))
    if metric == "jaccard":
        kept = kept.withColumn("w", F.lit(1.0))
    kept = written(kept)
    listed = written(kept.join(kept.groupBy("dim").agg(F.count(F.lit(1)).alias("df")), "dim"))
    size = listed.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("size"), F.max("df").alias("longest"))
    return written(listed.join(size, "id").select("id", "dim", "w", "size", "df", "longest"))


def _lists_met(ask: DataFrame, lists: DataFrame, chunk: int, best: tuple[int, str] | None = None) -> DataFrame:
    """Sums ``i, j, dot, size_i, size_j`` over dimensions that ``ask`` and ``lists`` share, dealt by i; long lists are dealt over chunks.
    ``best`` (k, metric) leaves out pairs that k others of their row are nearer than.

    A list travels to a row packed and is opened where the row's sums are made, so a pair is never shuffled: it is added up in
    the partition of i, and leaves it only if it may be needed."""
    parts = F.greatest(F.ceil(F.col("df") / F.lit(chunk)), F.lit(1)).cast("int")
    left = ask.select(F.col("id").alias("i"), "dim", F.col("w").alias("wi"), F.col("size").alias("size_i"),
                      F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = lists.select("dim", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.struct("id", "w", "size").alias("e"))
    right = right.groupBy("dim", "part").agg(F.sort_array(F.collect_list("e")).alias("es")).select(
        "dim", "part", F.col("es.id").alias("js"), F.col("es.w").alias("ws"), F.col("es.size").alias("sizes"))
    right = right.mapInArrow(_packed, f"dim {right.schema['dim'].dataType.simpleString()}, part int, es binary")
    pairs = ask.agg(F.sum("df")).first()[0] or 0
    n = max(int(ask.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PARTITION_PAIRS))
    met = left.join(right, ["dim", "part"]).select("i", "wi", "size_i", "es").repartition(n, "i").sortWithinPartitions("i")
    return met.mapInArrow(lambda batches: _summed(batches, best), "i long, j long, dot double, size_i double, size_j double")


def _packed(batches):
    for batch in batches:
        if batch.num_rows:
            ids, ws, sizes = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("js", "ws", "sizes"))
            made = L.pack(ids, ws, sizes, np.diff(batch.column("js").offsets.to_numpy()))
            yield pa.RecordBatch.from_pydict({"dim": batch.column("dim"), "part": batch.column("part"), "es": pa.array(made, pa.binary())})


def _summed(batches, best: tuple[int, str] | None):
    """Rows ``i, wi, size_i, es``, ascending by i, to sums; held are a piece of pairs and the sums of the row that may go on."""
    last = [np.zeros(0, kind) for kind in (np.int64, np.int64, float, float, float)]
    for batch in batches:
        if not batch.num_rows:
            continue
        i, wi, size_i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "wi", "size_i"))
        es = batch.column("es")
        ends = np.frombuffer(es.buffers()[1], np.int32)[es.offset:es.offset + len(es) + 1].astype(np.int64)
        raw = np.frombuffer(es.buffers()[2], np.uint8)
        piece = np.cumsum(L.lengths(raw, ends[:-1])) // PIECE_PAIRS
        cuts = [*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), len(i)]
        for a, b in zip(cuts, cuts[1:]):
            j, wj, size_j, of = L.unpack(raw[ends[a]:ends[b]], ends[a:b] - ends[a])
            of = of + a
            other = i[of] != j
            j, wj, size_j, of = j[other], wj[other], size_j[other], of[other]
            i_, j_, dot, si, sj = (np.concatenate(x) for x in zip(last, (i[of], j, wi[of] * wj, size_i[of], size_j)))
            if not len(i_):
                continue
            order = np.lexsort((j_, i_))
            i_, j_ = i_[order], j_[order]
            first = np.flatnonzero(np.concatenate([[True], (i_[1:] != i_[:-1]) | (j_[1:] != j_[:-1])]))
            sums = [i_[first], j_[first], np.add.reduceat(dot[order], first), si[order[first]], sj[order[first]]]
            open_ = int(np.searchsorted(sums[0], sums[0][-1]))
            yield _nearest([x[:open_] for x in sums], best)
            last = [x[open_:] for x in sums]
    yield _nearest(last, best)


def _nearest(sums: list[np.ndarray], best: tuple[int, str] | None) -> pa.RecordBatch:
    i, _, dot, si, sj = sums
    if best is not None and len(i):
        k, metric = best
        low = dot / (np.sqrt(si) * np.sqrt(sj)) if metric == "cosine" else dot / (si + sj - dot)
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        many = np.diff(np.append(first, len(i)))
        ranked = low[np.lexsort((-low, i))]
        limit = ranked[first + np.minimum(many, k) - 1] - SLACK  # equal ones stay: the merge ranks them
        keep = low >= np.repeat(limit, many)
        sums = [x[keep] for x in sums]
    return pa.RecordBatch.from_pydict(dict(zip(("i", "j", "dot", "size_i", "size_j"), sums)))


def _similarity(metric: str) -> Column:
    """From a whole sum the similarity; from a partial one a lower bound of it."""
    if metric == "cosine":
        return F.col("dot") / (F.sqrt("size_i") * F.sqrt("size_j"))
    return F.col("dot") / (F.col("size_i") + F.col("size_j") - F.col("dot"))


def _most(metric: str) -> Column:
    """The similarity that a pair can reach at most, given its partial sum and the row's suffix ``rest``."""
    if metric == "cosine":
        return F.col("dot") / (F.sqrt("size_i") * F.sqrt("size_j")) + F.col("rest")
    return F.col("dot") / F.col("size_i") + F.col("rest")


def sparse_knn(rows: DataFrame, k: int, metric: str = "cosine", ids: DataFrame | None = None, rare: int = RARE,
               chunk: int = CHUNK) -> DataFrame:
    """``i, j, d, rk``: the k nearest others of every row, exactly; ``ids`` (``id``) may list rows without dimensions."""
    if metric not in METRICS:
        raise ValueError(f"sparse neighbours are by {' or '.join(METRICS)}, not {metric!r}")
    if k < 1:
        raise ValueError(f"k={k} neighbours")
    entries = _entries(rows, metric)
    few = entries.filter(F.col("df") <= rare)
    nearest = Window.partitionBy("i").orderBy("d", "j")

    def best(pairs: DataFrame) -> DataFrame:
        ranked = pairs.select("i", "j", (F.lit(1.0) - _similarity(metric)).alias("d"), _similarity(metric).alias("low"))
        return written(ranked.withColumn("rk", F.row_number().over(nearest)).filter(F.col("rk") <= k))

    first = best(_lists_met(few, few, chunk, (k, metric)))
    common = entries.filter(F.col("longest") > rare)
    everyone = entries.select("id")
    if ids is not None:
        everyone = everyone.union(ids.select(F.col("id").cast("long").alias("id")).filter("id IS NOT NULL"))
    everyone = written(everyone.distinct())
    if common.isEmpty():  # the sums over rare dimensions are whole
        return _filled(first, everyone, k)
    bounds = first.filter(F.col("rk") == k).select(F.col("i").alias("id"), "low")
    onward = Window.partitionBy("id").orderBy("df", "dim").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum(F.col("w") * F.col("w")).over(onward) / F.col("size")
    suffix = (F.sqrt(left) if metric == "cosine" else left).alias("suffix")
    ordered = common.select("*", suffix).join(bounds, "id", "left").fillna(0.0, subset=["low"])
    marked = written(ordered.withColumn("asks", F.col("suffix") >= F.col("low") - SLACK))
    rest = marked.groupBy("id").agg(
        F.max("low").alias("low"), F.max(F.when(~F.col("asks"), F.col("suffix")).otherwise(0.0)).alias("rest"))
    pairs = _lists_met(marked.filter("asks"), entries, chunk).join(rest.withColumnRenamed("id", "i"), "i")
    pairs = written(pairs.filter(_most(metric) >= F.col("low") - SLACK).drop("low", "rest"))
    unasked = marked.filter("NOT asks").select(F.col("id").alias("i"), "dim", F.col("w").alias("wi"))
    held = entries.select(F.col("id").alias("j"), "dim", F.col("w").alias("wj"))
    added = pairs.select("i", "j").join(unasked, "i").join(held, ["j", "dim"]).groupBy("i", "j").agg(
        F.sum(F.col("wi") * F.col("wj")).alias("more"))
    whole = pairs.join(added, ["i", "j"], "left").withColumn("dot", F.col("dot") + F.coalesce("more", F.lit(0.0)))
    later = best(whole)
    ids_later = common.select(F.col("id").alias("i")).distinct()
    return _filled(later.unionByName(first.join(ids_later, "i", "left_anti")), everyone, k)


def _filled(found: DataFrame, everyone: DataFrame, k: int) -> DataFrame:
    """Rows with fewer than k entries get those with the smallest ids that share nothing with them, at distance 1."""
    counts = found.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("c"), F.collect_set("j").alias("js"))
    short = everyone.join(counts, "id", "left").filter(F.coalesce("c", F.lit(0)) < k)
    first = F.broadcast(everyone.orderBy("id").limit(2 * k).agg(F.sort_array(F.collect_list("id")).alias("first")))
    none = F.array().cast("array<long>")
    free = F.array_except(F.array_except("first", F.array("id")), F.coalesce("js", none))
    many = F.lit(k) - F.coalesce("c", F.lit(0)).cast("int")
    fill = short.join(first).select(  # one row
        F.col("id").alias("i"), F.coalesce("c", F.lit(0)).cast("int").alias("c"), F.posexplode(F.slice(free, F.lit(1), many)))
    return found.select("i", "j", "d", "rk").unionByName(
        fill.select("i", F.col("col").alias("j"), F.lit(1.0).alias("d"), (F.col("c") + F.col("pos") + 1).alias("rk")))
