"""Which pairs of rows of two blocks may lie within a limit: cheap lower bounds in front of exact distances.

A screen is made from both blocks. ``pairs(a, at, limit)`` names the pairs of query rows ``a`` and reference rows ``at`` whose
distance may be at most the query's limit; it may name too many, never too few. ``exact`` measures named pairs, by the same
arithmetic as the metric itself, on rows prepared once (ranks, masses).

* lengths, angles, rank correlation: one matrix product;
* Jensen-Shannon: ln 2 times the squared Hellinger distance is a lower bound of it, again a matrix product; what passes is
  estimated from entropies in single precision;
* sums and maxima over entries: entry by entry on tiles that stay in the cache, on 16-bit steps of the blocks' ranges, or in
  single precision where those steps are too coarse (in double where that can't hold the entries);
* bits: words of 64;
* any other metric: the metric itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from trefoil.functions import metrics

#: Elements of one tile of query by reference rows.
TILE = 1 << 18
#: Elements of one temporary (queries x references x dims) array of metrics without a screen.
CUBE = 4_000_000
#: Pairs of rows held at once by a second screen.
HELD = 2048
#: Largest sum of 16-bit steps.
STEPS = 32_000
#: Slack of comparisons in double precision.
SLACK = 1e-10


def _named(mask: np.ndarray):
    flat = np.flatnonzero(mask)
    return flat // mask.shape[1], flat % mask.shape[1]


class Plain:
    """No bound: the metric on every pair."""

    def __init__(self, q: np.ndarray, r: np.ndarray, fn: Callable):
        self.q, self.r, self.fn = q, r, fn

    def step(self, width: int) -> int:
        return max(1, CUBE // max(1, width * self.r.shape[1]))

    def pairs(self, a, at, limit):
        dist = np.asarray(self.fn(self.q[a][:, None, :], self.r[at][None]), dtype=float)
        rows, cols = _named(dist <= limit[:, None])
        return rows, cols, dist[rows, cols]

    def exact(self, rows, cols):
        return np.asarray(self.fn(self.q[rows], self.r[cols]), dtype=float)


class _Tiled(Plain):
    def step(self, width: int) -> int:
        return max(1, TILE // max(1, width))


class Lengths(_Tiled):
    """Euclidean length, or the chord of rows whose last entry marks zero vectors (their length is below the chord)."""

    def __init__(self, q, r, fn):
        super().__init__(q, r, fn)
        centre = r.mean(0) if len(r) else 0.0
        self.left, right = q - centre, r - centre
        self.q2, r2 = np.einsum("ij,ij->i", self.left, self.left), np.einsum("ij,ij->i", right, right)
        self.left = np.hstack([self.left, np.ones((len(q), 1))])
        self.right = np.hstack([right, -0.5 * r2[:, None]])
        self.most = r2.max(initial=0.0)

    def pairs(self, a, at, limit):
        q2, far = self.q2[a], limit * limit
        floor = 0.5 * (q2 - far - SLACK * (q2 + self.most + far) - 1e-300)
        return *_named(~(self.left[a] @ self.right[at].T < floor[:, None])), None


class Ranks(_Tiled):
    """Rank correlation: rows are ranked once."""

    def __init__(self, q, r, fn):
        super().__init__(metrics.average_ranks(q), metrics.average_ranks(r), metrics.correlation)
        self.left, self.right = self._unit(self.q), self._unit(self.r)

    @staticmethod
    def _unit(x):
        x = x - x.mean(-1, keepdims=True)
        size = np.sqrt(np.sum(x * x, -1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size != 0)

    def pairs(self, a, at, limit):
        return *_named(~(self.left[a] @ self.right[at].T < (1.0 - limit - 1e-9)[:, None])), None


class Divergence(_Tiled):
    """Jensen-Shannon: at least ln 2 (1 - sum sqrt(p q)); rows with negative entries have no bound."""

    def __init__(self, q, r, fn):
        super().__init__(q, r, fn)
        p, s = metrics._mass(q + metrics.EPSILON), metrics._mass(r + metrics.EPSILON)
        self.bounded = bool((p > 0).all() and (s > 0).all())
        if self.bounded:
            self.left, self.right = np.sqrt(p), np.sqrt(s)
            self.p, self.s = p.astype(np.float32), s.astype(np.float32)
            self.ep, self.es = np.sum(p * np.log(p), -1), np.sum(s * np.log(s), -1)

    def step(self, width: int) -> int:
        return super().step(width) if self.bounded else Plain.step(self, width)

    def pairs(self, a, at, limit):
        if not self.bounded:
            return super().pairs(a, at, limit)
        floor = 1.0 - (limit * (1 + 1e-9) + 1e-9) / np.log(2.0)
        rows, cols = _named(~(self.left[a] @ self.right[at].T < floor[:, None]))
        p, s, ep, es = self.p[a], self.s[at], self.ep[a], self.es[at]
        keep = np.ones(len(rows), bool)
        # Rounding of single sums of at most two masses, logarithms below 2 ln(dims / EPSILON) included.
        slack = 1e-6 * p.shape[1] ** 0.5 + 2e-5
        for b in range(0, len(rows), HELD):
            i, j = rows[b:b + HELD], cols[b:b + HELD]
            both = p[i]
            both += s[j]
            log = np.log(both)
            both = np.einsum("ij,ij->i", both, log)
            keep[b:b + HELD] = 0.5 * (ep[i] + es[j] - both) + np.log(2.0) <= limit[i] + slack
        return rows[keep], cols[keep], None


class Entries(_Tiled):
    """Sums (``manhattan``, ``canberra``) or maxima (``chebyshev``) over entries."""

    def __init__(self, q, r, fn, kind: str = "manhattan"):
        super().__init__(q, r, fn)
        self.kind = kind
        size = np.concatenate([np.abs(x[x != 0]) for x in (q, r)])
        self.type = np.float32 if not len(size) or (size.min() > 1e-15 and size.max() < 1e15) else np.float64
        single = self.type is np.float32
        self.left, self.right = (np.ascontiguousarray(x.T, self.type) for x in (q, r))
        self.sizes = np.abs(self.right) + self.type(1e-30 if single else 1e-300)
        # What rounding may add: of the entries, of a ratio, and of the running sum.
        unit, dims = float(np.finfo(self.type).eps), q.shape[1]
        if kind == "canberra":
            self.add, self.part = 8.0 * unit * dims, unit * dims
        else:
            most = [np.abs(x).sum(1).max(initial=0.0) if kind == "manhattan" else np.abs(x).max(initial=0.0) for x in (q, r)]
            self.add, self.part = 2.0 * unit * sum(most), unit * (dims + 2)
            self._steps(q, r)

        self.at, self.taken = None, {}

    def _columns(self, name: str, at: np.ndarray) -> np.ndarray:
        """Columns of a table by entries, side by side in memory; kept while query rows pass the same references."""
        if at is not self.at:
            self.at, self.taken = at, {}
        if name not in self.taken:
            self.taken[name] = np.take(getattr(self, name), at, axis=1)
        return self.taken[name]

    def _steps(self, q, r) -> None:
        """Rows in steps of a size at which a sum (maximum) of differences fits 16 bits; one entry's difference is off by one."""
        self.size = 0.0
        if not len(q) or not len(r) or q.shape[1] > STEPS // 4:
            return
        low = np.minimum(q.min(0), r.min(0))
        span = np.maximum(q.max(0), r.max(0)) - low
        self.off = q.shape[1] if self.kind == "manhattan" else 1
        self.size = float(span.sum() if self.kind == "manhattan" else span.max()) / (STEPS - self.off)
        if not 1e-290 < self.size < 1e290:
            self.size = 0.0
            return
        self.q_steps, self.r_steps = (np.ascontiguousarray(np.rint((x - low) / self.size).T.astype(np.int16)) for x in (q, r))

    def _near_steps(self, a, at, limit):
        left, right = np.take(self.q_steps, a, axis=1), self._columns("r_steps", at)
        total = np.zeros((len(a), right.shape[1]), np.int16)
        part, join = np.empty_like(total), np.add if self.kind == "manhattan" else np.maximum
        for c in range(len(left)):
            np.subtract(left[c][:, None], right[c][None], out=part)
            np.abs(part, out=part)
            join(total, part, out=total)
        far = np.minimum(limit / self.size * (1 + 1e-9) + self.off + 1, 32_767).astype(np.int16)
        return *_named(total <= far[:, None]), None

    def pairs(self, a, at, limit):
        if self.kind != "canberra" and self.size and self.off * self.size <= 0.1 * np.median(limit):
            return self._near_steps(a, at, limit)
        step = max(1, len(a) // 4)  # single entries take twice the place of steps, and need a second tile
        found = [self._near_entries(a[b:b + step], at, limit[b:b + step]) for b in range(0, len(a), step)]
        rows = [rows + b for (rows, _), b in zip(found, range(0, len(a), step))]
        return np.concatenate(rows), np.concatenate([cols for _, cols in found]), None

    def _near_entries(self, a, at, limit):
        left, right = np.take(self.left, a, axis=1), self._columns("right", at)
        total, part = np.zeros((len(a), right.shape[1]), self.type), np.empty((len(a), right.shape[1]), self.type)
        size, both = (self._columns("sizes", at), np.empty_like(part)) if self.kind == "canberra" else (None, None)
        for c in range(len(left)):
            np.subtract(left[c][:, None], right[c][None], out=part)
            np.abs(part, out=part)
            if self.kind == "chebyshev":
                np.maximum(total, part, out=total)
                continue
            if both is not None:
                np.add(np.abs(left[c])[:, None], size[c][None], out=both)
                np.divide(part, both, out=part)
            total += part
        far = (limit * (1.0 + 2.0 * self.part) + self.add) * (1.0 + 1e-6)
        return _named(~(total > far[:, None].astype(self.type)))


class Flows(Entries):
    """Transport on a line: sums over entries of running masses, which are made once."""

    def __init__(self, q, r, fn):
        q, r = (np.cumsum(metrics._mass(x), -1) for x in (q, r))
        super().__init__(q, r, lambda a, b: metrics.minkowski(a, b, 1.0))


class Bits(_Tiled):
    """Differing bits of packed bytes, 64 at a time."""

    def __init__(self, q, r, fn):
        super().__init__(q, r, fn)
        self.left, self.right = self._words(q), self._words(r)

    @staticmethod
    def _words(x):
        packed = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
        packed[:, :x.shape[1]] = metrics._bytes(x)
        return np.ascontiguousarray(packed.view(np.uint64).T)

    def pairs(self, a, at, limit):
        left, right = np.take(self.left, a, axis=1), np.take(self.right, at, axis=1)
        total = np.zeros((len(a), right.shape[1]), np.int32)
        word, bits = np.empty(total.shape, np.uint64), np.empty(total.shape, np.uint8)
        for c in range(len(left)):
            np.bitwise_xor(left[c][:, None], right[c][None], out=word)
            np.bitwise_count(word, out=bits)
            total += bits
        return *_named(total <= limit[:, None]), None


#: Screens by canonical name, for metrics without parameters.
SCREENS: dict[str, Callable] = {
    "euclidean": Lengths, "spearmanr": Ranks, "jensen_shannon": Divergence, "wasserstein_1d": Flows, "bit_hamming": Bits,
    "manhattan": Entries,
    "chebyshev": lambda q, r, fn: Entries(q, r, fn, "chebyshev"),
    "canberra": lambda q, r, fn: Entries(q, r, fn, "canberra"),
}
