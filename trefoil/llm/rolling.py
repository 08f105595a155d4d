"""Rolling hashes of words and bytes in numpy, and bounded Bloom filters of them."""

from __future__ import annotations

import numpy as np
import xxhash

_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept between calls."""
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        have = np.full(size, np.uint64(base % (1 << 64)), np.uint64)
        have[0] = 1
        have = _TABLES[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of values[start:end] (polynomial, mod 2^64, then mixed); ``values`` are unsigned 64-bit."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASES[which], n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSES[which], n + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word of a whole text."""
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(w) for w in (text or "").encode().split()], np.uint64)


def windows_hash(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return spans_hash(values, starts, starts + size, which)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``size`` from one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps[:n]) > 0


class Bloom:
    """A filter in segments: the top bits of a hash choose the segment, three further parts of it the bits. Segments are
    built apart. Its size is fixed, so it can be broadcast; when overfull it lets more pass, never less."""

    SEGMENT_BITS = 1 << 19

    def __init__(self, segments: int, data: np.ndarray | None = None):
        self.segments = segments
        self.data = np.zeros(segments * self.SEGMENT_BITS // 8, np.uint8) if data is None else data

    @classmethod
    def segment_of(cls, hashes: np.ndarray, segments: int) -> np.ndarray:
        return (hashes >> np.uint64(48)) % np.uint64(segments)

    def _bits(self, hashes: np.ndarray, turn: int) -> np.ndarray:
        inner = (hashes >> np.uint64((0, 16, 29)[turn])) % np.uint64(self.SEGMENT_BITS)
        return self.segment_of(hashes, self.segments) * np.uint64(self.SEGMENT_BITS) + inner

    def add(self, hashes: np.ndarray) -> None:
        for turn in range(3):
            bits = self._bits(hashes, turn)
            np.bitwise_or.at(self.data, bits >> np.uint64(3), (1 << (bits & np.uint64(7))).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        at = np.arange(len(hashes))
        for turn in range(3):
            bits = self._bits(hashes[at], turn)
            hit = (self.data[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1
            out[at[hit == 0]] = False
            at = at[hit == 1]
        return out
