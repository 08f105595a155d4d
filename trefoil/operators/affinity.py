"""Affinities between rows from neighbour tables: ``p(i, j, p)``.

Every builder takes ``knn(i, j, d, rk)``. ``symmetrize`` adds the transpose; ``pair-wise`` makes the
whole table sum to 1, ``point-wise`` every row. The ``*_to_new`` forms connect new rows to the
reference rows and are always point-wise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trefoil.functions.kernels import calibrate


def n_neighbors(n: int, perplexity: float) -> int:
    return min(n - 1, int(3 * perplexity))


def effective_perplexity(perplexity: float, k: int) -> float:
    """A perplexity above the neighbour count falls back to a third of it."""
    if perplexity <= 0:
        raise ValueError("perplexity must be positive")
    return k / 3 if perplexity > k else perplexity


def check_perplexities(perplexities: list[float], n: int) -> list[float]:
    """Sorted scales; those above (n-1)/3 are capped there, and the cap is kept once."""
    if any(p <= 0 for p in perplexities):
        raise ValueError("perplexities must be positive")
    cap = (n - 1) / 3
    return sorted({min(p, cap) for p in perplexities})


def limit_neighbors(knn: DataFrame, perplexity: float, have: int | None = None) -> DataFrame:
    """Reuse a neighbour table for a smaller perplexity: keep the first int(3*perplexity)."""
    want = int(3 * perplexity)
    if have is not None and want > have:
        raise ValueError(f"perplexity {perplexity} needs {want} neighbours, only {have} are known")
    return knn.filter(F.col("rk") <= want)


def _rows(knn: DataFrame) -> DataFrame:
    """One row per i with its neighbour list; a list is as long as k."""
    pair = F.struct("rk", "j", "d")
    return knn.groupBy("i").agg(F.sort_array(F.collect_list(pair)).alias("nn"))


def _kernel_column(perplexities: list[float], shared_bracket: bool) -> Column:
    scales = [float(p) for p in perplexities]

    def batch(d: pd.Series) -> pd.Series:
        if len(d) == 0:
            return pd.Series([], dtype=object)
        width = max(len(x) for x in d)
        dist = np.zeros((len(d), width))
        known = np.zeros((len(d), width), bool)
        for row, x in enumerate(d):
            dist[row, : len(x)] = x
            known[row, : len(x)] = True
        mixed = calibrate(dist ** 2, known, scales, shared_bracket).sum(0)
        mixed = mixed / mixed.sum(1, keepdims=True)
        return pd.Series([row[: len(x)] for row, x in zip(mixed, d)])

    return F.pandas_udf(batch, "array<double>")(F.col("nn.d"))


def conditional(knn: DataFrame, perplexities: list[float], shared_bracket: bool = True) -> DataFrame:
    """Row-normalised Gaussian kernels calibrated to the perplexities (their mixture if several)."""
    p = _rows(knn).withColumn("pp", _kernel_column(perplexities, shared_bracket))
    zipped = F.explode(F.arrays_zip(F.col("nn.j").alias("j"), F.col("pp").alias("p")))
    return p.select("i", zipped.alias("z")).select("i", F.col("z.j").alias("j"), F.col("z.p").alias("p"))


def gaussian(knn: DataFrame, sigma: float) -> DataFrame:
    """Row-normalised kernels of one fixed width."""
    w = F.exp(-(F.col("d") * F.col("d")) / F.lit(2.0 * sigma * sigma))
    weighted = knn.select("i", "j", w.alias("p"))
    total = weighted.groupBy("i").agg(F.sum("p").alias("_t"))
    return weighted.join(total, "i").select("i", "j", (F.col("p") / F.col("_t")).alias("p"))


def symmetrized(p: DataFrame, how: str = "mean") -> DataFrame:
    """``mean`` averages with the transpose, ``max`` marks pairs present either way, ``none`` keeps."""
    if how == "none":
        return p.select("i", "j", "p")
    both = p.select("i", "j", "p").unionByName(
        p.select(F.col("j").alias("i"), F.col("i").alias("j"), "p")
    )
    if how == "mean":
        return both.groupBy("i", "j").agg((F.sum("p") / 2).alias("p"))
    if how == "max":
        return both.groupBy("i", "j").agg(F.lit(1.0).alias("p"))
    raise ValueError(f"unknown symmetrization {how!r}")


def normalized(p: DataFrame, how: str = "pair-wise") -> DataFrame:
    if how == "pair-wise":
        total = p.agg(F.sum("p").alias("_t"))
        # A one-row side.
        return p.join(F.broadcast(total)).select("i", "j", (F.col("p") / F.col("_t")).alias("p"))
    if how == "point-wise":
        total = p.groupBy("i").agg(F.sum("p").alias("_t"))
        return p.join(total, "i").select("i", "j", (F.col("p") / F.col("_t")).alias("p"))
    raise ValueError(f"unknown normalization {how!r}")


def perplexity_based(knn: DataFrame, perplexity: float, k: int, symmetrize: bool = True,
                     normalization: str = "pair-wise") -> DataFrame:
    """One calibrated scale over the first k neighbours."""
    own = conditional(knn.filter(F.col("rk") <= k), [effective_perplexity(perplexity, k)])
    return normalized(symmetrized(own) if symmetrize else own, normalization)


def mixture(knn: DataFrame, perplexities: list[float], symmetrize: bool = True,
            normalization: str = "pair-wise", shared_bracket: bool = True) -> DataFrame:
    """Several scales mixed inside the kernel."""
    own = conditional(knn, sorted(perplexities), shared_bracket)
    return normalized(symmetrized(own) if symmetrize else own, normalization)


def multiscale(knn: DataFrame, perplexities: list[float], symmetrize: bool = True,
               normalization: str = "pair-wise") -> DataFrame:
    """One full affinity table per scale, then their normalised sum."""
    parts = [mixture(knn, [p], symmetrize, normalization) for p in sorted(perplexities)]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return normalized(total.groupBy("i", "j").agg(F.sum("p").alias("p")), normalization)


def fixed_sigma(knn: DataFrame, sigma: float, symmetrize: bool = True,
                normalization: str = "pair-wise") -> DataFrame:
    own = gaussian(knn, sigma)
    return normalized(symmetrized(own) if symmetrize else own, normalization)


def uniform(knn: DataFrame, symmetrize: str | bool = "max") -> DataFrame:
    """Equal weight on every neighbour pair."""
    how = {True: "max", False: "none"}.get(symmetrize, symmetrize)
    ones = knn.select("i", "j", F.lit(1.0).alias("p"))
    return normalized(symmetrized(ones, how))


def precomputed(p: DataFrame, normalize: bool = True) -> DataFrame:
    return normalized(p) if normalize else p.select("i", "j", "p")


def to_new(knn: DataFrame, perplexities: list[float]) -> DataFrame:
    """Rows of new points over their reference neighbours; each sums to 1."""
    return conditional(knn, sorted(perplexities))


def to_new_multiscale(knn: DataFrame, perplexities: list[float]) -> DataFrame:
    return multiscale(knn, perplexities, symmetrize=False, normalization="point-wise")


def to_new_fixed_sigma(knn: DataFrame, sigma: float) -> DataFrame:
    return gaussian(knn, sigma)


def to_new_uniform(knn: DataFrame) -> DataFrame:
    return normalized(knn.select("i", "j", F.lit(1.0).alias("p")), "point-wise")
