"""Lists of rows that share a dimension, packed losslessly as bytes: ids as steps from one to the next, whole numbers as integers,
other weights by the bits of their doubles; each field of a list in as many bits as its largest value needs."""

from __future__ import annotations

import numpy as np

#: Bytes before a list's fields: entries, then for each of three fields what is added, the bits a value is shifted by and takes.
_HEAD = 4 + 3 * 10
WHOLE = 1 << 52


def _words(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) // 8 + 2, np.uint64)
    out.view(np.uint8)[: len(data)] = data
    return out


def _fields(ids: np.ndarray, w: np.ndarray, size: np.ndarray, starts: np.ndarray, many: np.ndarray):
    """Unsigned values of the three fields, and per list whether the last two are integers (shift 64 marks doubles)."""
    steps = np.diff(ids, prepend=ids[:1])
    steps[starts] = 0
    yield steps.astype(np.uint64), ids[starts].astype(np.uint64), np.zeros(len(starts), bool)
    for x in (w, size):
        whole = np.logical_and.reduceat((x == np.floor(x)) & (np.abs(x) < WHOLE), starts)
        exact = np.repeat(whole, many)
        v = np.where(exact, np.where(exact, x, 0).astype(np.int64).view(np.uint64), np.ascontiguousarray(x, float).view(np.uint64))
        base = np.minimum.reduceat(v, starts)
        yield v - np.repeat(base, many), base, ~whole


def pack(ids: np.ndarray, w: np.ndarray, size: np.ndarray, many: np.ndarray) -> list[bytes]:
    """One value of bytes for each list; ``many`` are their lengths (1 and up), ids ascend within a list, weights are not negative."""
    if not len(many):
        return []
    starts = np.cumsum(many) - many
    fields = []
    for v, base, double in _fields(ids, w, size, starts, many):
        used = np.bitwise_or.reduceat(v, starts).tolist()
        shift = np.array([(x & -x).bit_length() - 1 if x else 0 for x in used])
        width = np.array([x.bit_length() for x in used]) - shift
        fields.append((v, base, double, shift, width, (many * width + 7) // 8))
    length = _HEAD + sum(f[5] for f in fields)
    begin = np.cumsum(length) - length
    out = _words(np.zeros(int(length.sum()), np.uint8))
    raw, at = out.view(np.uint8), begin + _HEAD
    raw[begin[:, None] + np.arange(4)] = many.astype("<u4").view(np.uint8).reshape(-1, 4)
    place = np.arange(len(ids)) - np.repeat(starts, many)
    for n, (v, base, double, shift, width, taken) in enumerate(fields):
        head = begin + 4 + 10 * n
        raw[head[:, None] + np.arange(8)] = base.astype("<u8").view(np.uint8).reshape(-1, 8)
        raw[head + 8], raw[head + 9] = shift + 128 * double, width
        bit = np.repeat(at * 8, many) + place * np.repeat(width, many)
        v, low = v >> np.repeat(shift, many).astype(np.uint64), (bit & 63).astype(np.uint64)
        np.bitwise_or.at(out, bit >> 6, v << low)
        np.bitwise_or.at(out, (bit >> 6) + 1, (v >> np.uint64(1)) >> (np.uint64(63) - low))
        at = at + taken
    return [raw[a:b].tobytes() for a, b in zip(begin, begin + length)]


def lengths(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Entries of the lists that begin at these bytes."""
    return raw[begin[:, None] + np.arange(4)].view("<u4").ravel().astype(np.int64) if len(begin) else np.zeros(0, np.int64)


def unpack(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights and sizes of the lists that begin at these bytes, one after the other, and the list of each entry."""
    many = lengths(raw, begin)
    of, total = np.repeat(np.arange(len(begin)), many), int(many.sum())
    place = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), of
    words, at, out = _words(raw), begin + _HEAD, []
    for n in range(3):
        head = begin + 4 + 10 * n
        base = raw[head[:, None] + np.arange(8)].view("<u8").ravel()
        shift, width = raw[head + 8].astype(np.int64), raw[head + 9].astype(np.int64)
        double, shift = shift >= 128, shift % 128
        bit = (at * 8)[of] + place * width[of]
        word, low = bit >> 6, (bit & 63).astype(np.uint64)
        v = (words[word] >> low) | ((words[word + 1] << np.uint64(1)) << (np.uint64(63) - low))
        mask = np.array([(1 << x) - 1 for x in range(65)], np.uint64)[width]
        v = (v & mask[of]) << shift.astype(np.uint64)[of]
        if n == 0:
            first = np.cumsum(many) - many
            v = np.cumsum(v)  # steps of a list start at 0
            out.append((v - v[first][of] + base[of]).view(np.int64))
        else:
            v = v + base[of]
            out.append(np.where(double[of], v.view(float), v.view(np.int64)))
        at = at + (many * width + 7) // 8
    return *out, of
