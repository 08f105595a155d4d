"""Distances between vectors, written once on broadcastable arrays (..., d) and used in batches.

Used by the block kernel of the neighbour join and by Arrow-batched column functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Metrics for which the triangle inequality allows pruning.
TRIANGLE = {"euclidean", "manhattan", "chebyshev", "minkowski", "seuclidean", "mahalanobis", "hamming", "wasserstein_1d",
            "bit_hamming"}

# Other names accepted for the same metric.
ALIASES = {
    "l2": "euclidean", "p": "minkowski", "l1": "manhattan", "cityblock": "manhattan",
    "taxicab": "manhattan", "infinity": "chebyshev", "linfinity": "chebyshev",
    "linfty": "chebyshev", "linf": "chebyshev", "matching": "hamming", "ip": "inner_product",
    "canberra": "canberra", "standardised_euclidean": "seuclidean", "weighted_minkowski": "wminkowski",
    "wasserstein-1d": "wasserstein_1d", "kantorovich-1d": "wasserstein_1d", "kantorovich_1d": "wasserstein_1d",
    "circular_wasserstein": "circular_kantorovich", "jensen-shannon": "jensen_shannon", "symmetric-kl": "symmetric_kl",
    "symmetric_kullback_liebler": "symmetric_kl",
}


def _ratio(num, den, empty=0.0):
    return np.divide(num, den, out=np.full(np.broadcast(num, den).shape, empty), where=den != 0)


def _truth(a, b):
    a, b = a != 0, b != 0
    tt = np.sum(a & b, -1).astype(float)
    tf = np.sum(a & ~b, -1).astype(float)
    ft = np.sum(~a & b, -1).astype(float)
    return tt, tf, ft, float(a.shape[-1])


def euclidean(a, b):
    return np.sqrt(np.sum((a - b) ** 2, -1))


def sqeuclidean(a, b):
    return np.sum((a - b) ** 2, -1)


def manhattan(a, b):
    return np.sum(np.abs(a - b), -1)


def chebyshev(a, b):
    return np.max(np.abs(a - b), -1)


def minkowski(a, b, p=2.0):
    return np.sum(np.abs(a - b) ** p, -1) ** (1.0 / p)


def wminkowski(a, b, p=2.0, w=1.0):
    return np.sum((np.asarray(w) * np.abs(a - b)) ** p, -1) ** (1.0 / p)


def seuclidean(a, b, V=1.0):
    return np.sqrt(np.sum((a - b) ** 2 / np.asarray(V), -1))


def mahalanobis(a, b, VI=None):
    diff = a - b
    return np.sqrt(np.einsum("...i,ij,...j->...", diff, np.asarray(VI), diff))


def cosine(a, b):
    dot = np.sum(a * b, -1)
    return 1.0 - _ratio(dot, np.sqrt(np.sum(a * a, -1) * np.sum(b * b, -1)))


def angular(a, b):
    return np.sqrt(np.maximum(2.0 * cosine(a, b), 0.0))


def true_angular(a, b):
    return np.arccos(np.clip(1.0 - cosine(a, b), -1.0, 1.0)) / np.pi


def correlation(a, b):
    return cosine(a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True))


def dot(a, b):
    return -np.sum(a * b, -1)


def inner_product(a, b):
    return 1.0 - np.sum(a * b, -1)


def braycurtis(a, b):
    return _ratio(np.sum(np.abs(a - b), -1), np.sum(np.abs(a + b), -1))


def canberra(a, b):
    return np.sum(_ratio(np.abs(a - b), np.abs(a) + np.abs(b)), -1)


def hamming(a, b):
    return np.mean(a != b, -1)


def jaccard(a, b):
    tt, tf, ft, _ = _truth(a, b)
    return _ratio(tf + ft, tt + tf + ft)


def dice(a, b):
    tt, tf, ft, _ = _truth(a, b)
    return _ratio(tf + ft, 2 * tt + tf + ft)


def kulsinski(a, b):
    tt, tf, ft, n = _truth(a, b)
    return (tf + ft - tt + n) / (tf + ft + n)


def rogerstanimoto(a, b):
    _, tf, ft, n = _truth(a, b)
    return 2 * (tf + ft) / (n + tf + ft)


def russellrao(a, b):
    tt, _, _, n = _truth(a, b)
    return (n - tt) / n


def sokalsneath(a, b):
    tt, tf, ft, _ = _truth(a, b)
    return _ratio(tf + ft, tf + ft + 0.5 * tt)


def yule(a, b):
    tt, tf, ft, n = _truth(a, b)
    ff = n - tt - tf - ft
    return _ratio(2 * tf * ft, tt * ff + tf * ft)


def haversine(a, b):
    s = np.sin(0.5 * (a - b)) ** 2
    return 2 * np.arcsin(np.sqrt(s[..., 0] + np.cos(a[..., 0]) * np.cos(b[..., 0]) * s[..., 1]))


def hellinger(a, b):
    norm = np.sqrt(np.sum(a, -1) * np.sum(b, -1))
    return np.sqrt(np.maximum(1.0 - _ratio(np.sum(np.sqrt(np.abs(a * b)), -1), norm), 0.0))


def average_ranks(x):
    """Ranks from 1 along the last axis; ties share their mean."""
    n = x.shape[-1]
    order = np.argsort(x, -1, kind="stable")
    ordered = np.take_along_axis(x, order, -1)
    place = np.broadcast_to(np.arange(n), x.shape)
    new = np.concatenate([np.ones(x.shape[:-1] + (1,), bool), ordered[..., 1:] != ordered[..., :-1]], -1)
    first = np.maximum.accumulate(np.where(new, place, 0), -1)
    ends = np.concatenate([new[..., 1:], np.ones(x.shape[:-1] + (1,), bool)], -1)
    last = np.minimum.accumulate(np.where(ends, place, n - 1)[..., ::-1], -1)[..., ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2.0 + 1.0, -1)
    return out


def spearmanr(a, b):
    return correlation(average_ranks(a), average_ranks(b))


def tsss(a, b):
    """Triangle times sector: the area between two vectors and that of the ring their difference sweeps, angle widened by 10 degrees."""
    x, y = np.sqrt(np.sum(a * a, -1)), np.sqrt(np.sum(b * b, -1))
    angle = np.arccos(np.clip(_ratio(np.sum(a * b, -1), x * y), -1.0, 1.0)) + np.radians(10.0)
    return 0.5 * x * y * np.sin(angle) * (euclidean(a, b) + np.abs(x - y)) ** 2 * angle


def _mass(x):
    """Rows as distributions; a row without mass stays zero."""
    return _ratio(x, np.sum(x, -1, keepdims=True))


def wasserstein_1d(a, b, p=1.0):
    return minkowski(np.cumsum(_mass(a), -1), np.cumsum(_mass(b), -1), p)


def circular_kantorovich(a, b, p=1.0):
    """Transport on a circle: the flow through every place is free up to a constant, whose best value is the median."""
    flow = np.cumsum(_mass(a), -1) - np.cumsum(_mass(b), -1)
    return np.sum(np.abs(flow - np.median(flow, -1, keepdims=True)) ** p, -1) ** (1.0 / p)


def sinkhorn(a, b, cost=None, regularization=1.0, rounds=64):
    """Entropic transport between rows as distributions; places are all 1 apart unless ``cost`` (d, d) is given."""
    a, b = np.broadcast_arrays(_mass(a), _mass(b))
    cost = 1.0 - np.eye(a.shape[-1]) if cost is None else np.asarray(cost, float)
    kernel = np.exp(-cost / regularization)
    u = np.ones_like(a)
    for _ in range(rounds):
        v = _ratio(b, u @ kernel)
        u = _ratio(a, v @ kernel.T)
    return np.sum(u * (v @ (kernel * cost).T), -1)


#: Added to every entry before logarithms, so that empty entries have one (fixed value: spacing of single floats at 1).
EPSILON = 2.0 ** -23


def jensen_shannon(a, b):
    p, q = _mass(a + EPSILON), _mass(b + EPSILON)
    m = 0.5 * (p + q)
    return 0.5 * np.sum(p * np.log(p / m) + q * np.log(q / m), -1)


def symmetric_kl(a, b):
    p, q = _mass(a + EPSILON), _mass(b + EPSILON)
    return np.sum((p - q) * np.log(p / q), -1)


def _bytes(x):
    return np.asarray(x).astype(np.uint8)


def bit_hamming(a, b):
    """Differing bits of rows of packed bytes (entries 0 to 255)."""
    return np.sum(np.bitwise_count(_bytes(a) ^ _bytes(b)), -1).astype(float)


def bit_jaccard(a, b):
    a, b = _bytes(a), _bytes(b)
    either = np.sum(np.bitwise_count(a | b), -1).astype(float)
    return _ratio(np.sum(np.bitwise_count(a ^ b), -1).astype(float), either)


METRICS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        euclidean, sqeuclidean, manhattan, chebyshev, minkowski, wminkowski, seuclidean, mahalanobis,
        cosine, angular, true_angular, correlation, dot, inner_product, braycurtis, canberra, hamming,
        jaccard, dice, kulsinski, rogerstanimoto, russellrao, sokalsneath, yule, haversine, hellinger,
        spearmanr, tsss, wasserstein_1d, circular_kantorovich, sinkhorn, jensen_shannon, symmetric_kl, bit_hamming, bit_jaccard,
    )
}
METRICS["sokalmichener"] = rogerstanimoto


def resolve(metric: str | Callable, params: dict | None = None) -> tuple[str, Callable]:
    """(canonical name, function of two broadcastable arrays); callables take two 1-D vectors."""
    if callable(metric):
        return "callable", np.vectorize(metric, signature="(d),(d)->()")
    name = ALIASES.get(metric, metric)
    if name not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(METRICS)}")
    base, params = METRICS[name], dict(params or {})
    return name, (lambda a, b: base(a, b, **params)) if params else base


def distance(left: Column, right: Column, metric: str | Callable = "euclidean", params: dict | None = None) -> Column:
    """Distance of two array columns, evaluated on whole Arrow batches."""
    _, fn = resolve(metric, params)

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        if len(a) == 0:
            return pd.Series([], dtype=float)
        return pd.Series(np.asarray(fn(np.stack(a.to_list()), np.stack(b.to_list())), dtype=float))

    return F.pandas_udf(batch, T.DoubleType())(left, right)
