"""Small NumPy helpers run inside Spark tasks on one bounded block at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from trefoil.functions.screens import SCREENS, Plain

# Pairs that are measured exactly at once.
_MEASURED = 32_768
# References of one step once a query has its k; steps before are shorter, as every pair passes then.
_WIDE, _FIRST = 2048, 32


class Nearest:
    """The k nearest references of every query by (distance, id), kept while reference rows pass in steps.

    ``bound`` is a distance that a query's k-th nearest is known not to exceed. A screen names the pairs within the limits
    so far; only those are measured.
    """

    def __init__(self, q_ids, q, r_ids, r, k: int, fn: Callable, screen: str, drop_same: bool, bound=None):
        self.q_ids, self.r_ids, self.k, self.drop_same = q_ids, r_ids, k, drop_same
        self.screen = SCREENS.get(screen, Plain)(q, r, fn)
        self.d = np.full((len(q), k), np.inf)
        self.j = np.full((len(q), k), np.iinfo(np.int64).max)
        self.limit = np.full(len(q), np.inf) if bound is None else np.asarray(bound, float).copy()

    def meet(self, rows: np.ndarray, refs: np.ndarray, floor: np.ndarray | None = None) -> None:
        """Queries ``rows`` meet references ``refs``; ``floor`` (ascending) is a distance that a reference is not below."""
        at, width = 0, max(_FIRST, 2 * self.k)
        while at < len(refs):
            worst = self.limit[rows].max(initial=-np.inf)
            if floor is not None and floor[at] > worst + 1e-9:
                break
            width = _WIDE if np.isfinite(worst) else min(width, _WIDE)
            some = refs[at:at + width]
            step = self.screen.step(len(some))
            for a in range(0, len(rows), step):
                mine = rows[a:a + step]
                r, c, d = self.screen.pairs(mine, some, self.limit[mine])
                r, c = mine[r], some[c]
                if self.drop_same:
                    other = self.q_ids[r] != self.r_ids[c]
                    r, c, d = r[other], c[other], d if d is None else d[other]
                if d is None:
                    d = np.empty(len(r))
                    for b in range(0, len(r), _MEASURED):
                        d[b:b + _MEASURED] = self.screen.exact(r[b:b + _MEASURED], c[b:b + _MEASURED])
                self._take(r, self.r_ids[c], d)
            at, width = at + len(some), width * 4

    def _take(self, rows, ids, dist) -> None:
        fit = np.isfinite(dist) & (dist <= self.limit[rows])
        rows, ids, dist = rows[fit], ids[fit], dist[fit]
        if not len(rows):
            return
        hit = np.unique(rows)
        row = np.concatenate([np.repeat(hit, self.k), rows])
        d, j = np.concatenate([self.d[hit].ravel(), dist]), np.concatenate([self.j[hit].ravel(), ids])
        order = np.lexsort((j, d, row))
        first = np.searchsorted(row[order], hit)
        best = order[first[:, None] + np.arange(self.k)]
        self.d[hit], self.j[hit] = d[best], j[best]
        self.limit[hit] = np.minimum(self.limit[hit], self.d[hit, -1])

    def hits(self):
        rows, turn = np.nonzero(np.isfinite(self.d))
        return self.q_ids[rows], self.j[rows, turn], self.d[rows, turn]


def block_top_k(q_ids, q, r_ids, r, k, fn, screen: str, drop_same: bool):
    """The k nearest references of every query by (distance, id): arrays i, j, d."""
    near = Nearest(q_ids, q, r_ids, r, min(k, len(r)), fn, screen, drop_same)
    near.meet(np.arange(len(q)), np.arange(len(r)))
    return near.hits()


def calibrate(d2: np.ndarray, known: np.ndarray, perplexities, shared_bracket: bool = True,
              tol: float = 1e-8, max_iter: int = 200) -> np.ndarray:
    """Kernel values per scale, shape (scales, rows, k), whose row entropy is log(perplexity).

    ``d2`` are squared distances and ``known`` marks real entries. The precision starts at 1 and is
    bisected; an open end doubles or halves. ``shared_bracket`` keeps a row's bracket from one
    scale to the next (the default numbers depend on it), False starts each scale afresh.
    """
    eps = np.finfo(float).eps
    n = len(d2)
    lo, hi = np.full(n, -np.inf), np.full(n, np.inf)
    out = np.zeros((len(perplexities), *d2.shape))
    for h, perplexity in enumerate(perplexities):
        if not shared_bracket:
            lo, hi = np.full(n, -np.inf), np.full(n, np.inf)
        target = np.log(perplexity)
        tau = np.ones(n)
        open_rows = np.ones(n, bool)
        for _ in range(max_iter):
            kernel = np.where(known, np.sqrt(tau)[:, None] * np.exp(-d2 * tau[:, None] / 2), 0.0)
            total = kernel.sum(1) + eps
            entropy = (
                tau / 2 * (kernel / total[:, None] * d2).sum(1) + np.log(total) - np.log(tau) / 2
            )
            out[h][open_rows] = kernel[open_rows]
            gap = entropy - target
            open_rows = open_rows & ~(np.abs(gap) <= tol)
            if not open_rows.any():
                break
            up, down = open_rows & (gap > 0), open_rows & ~(gap > 0)
            lo = np.where(up, tau, lo)
            hi = np.where(down, tau, hi)
            with np.errstate(invalid="ignore"):
                tau = np.where(up, np.where(np.isinf(hi), tau * 2, (tau + hi) / 2), tau)
                tau = np.where(down, np.where(np.isinf(lo), tau / 2, (tau + lo) / 2), tau)
    return out
