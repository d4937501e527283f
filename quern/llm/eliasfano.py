"""Elias-Fano sequences in flat arrays, searched many values at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE, _ALL = U(1), U(0xFFFFFFFFFFFFFFFF)
WORDS = 4  # words of a directory block
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Place of the r-th set bit of a byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _p = np.flatnonzero(_BITS[_b])
    _SELECT[_b, : len(_p)] = _p


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of an ascending sequence of uint64: low bits packed, high bits in unary, zeros before each block."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> U(low)).astype(np.int64)
    size = (int(high[-1]) if n else 0) + n + 2
    words = (size + 63) // 64
    words += -words % WORDS
    bits = np.zeros(words * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").view(np.uint64)
    zeros = 64 * WORDS - np.bitwise_count(upper).reshape(-1, WORDS).sum(axis=1, dtype=np.int64)
    return {"meta": np.array([n, low, top >> low], np.uint64), "lower": _packed(values, low), "upper": upper, "zeros": np.concatenate([[0], np.cumsum(zeros)])}


def _packed(values: np.ndarray, low: int) -> np.ndarray:
    out = np.zeros(len(values) * low // 64 + 2, U)
    if low:
        v = values & ((_ONE << U(low)) - _ONE)
        at = np.arange(len(values), dtype=np.int64) * low
        word, shift = at >> 6, (at & 63).astype(U)
        np.bitwise_or.at(out, word, v << shift)
        over = (shift + U(low)) > U(64)
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return out


class Sequence:
    """Search in the arrays of ``build``, which may be memory maps."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low, self.top = (int(x) for x in arrays["meta"])
        self.lower, self.upper, self.zeros = arrays["lower"], arrays["upper"], arrays["zeros"]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the high bits; -1 for k = -1."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        block = np.clip(block, 0, len(self.zeros) - 2)
        rest = (k - self.zeros[block]).astype(np.int64)
        word = block * WORDS
        left = np.ones(len(k), bool)
        for _ in range(WORDS - 1):
            free = 64 - np.bitwise_count(self.upper[word]).astype(np.int64)
            left &= rest >= free
            rest = np.where(left, rest - free, rest)
            word = word + left
        free = ~self.upper[word]
        place = word * 64
        left = np.ones(len(k), bool)
        for _ in range(7):
            count = np.bitwise_count(free & U(0xFF)).astype(np.int64)
            left &= rest >= count
            rest = np.where(left, rest - count, rest)
            free = np.where(left, free >> U(8), free)
            place = place + 8 * left
        place = place + _SELECT[(free & U(0xFF)).astype(np.int64), np.clip(rest, 0, 7)]
        return np.where(k < 0, -1, place)

    def _next_zero(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero, which is the first one from ``at`` on: most often in the same word."""
        word = ~self.upper[at >> 6] >> (at & 63).astype(U)
        out = at + np.bitwise_count((word & (~word + _ONE)) - _ONE)
        far = np.flatnonzero(word == 0)
        if len(far):
            out[far] = self._zero(k[far])
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is not in the sequence."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = x >> U(self.low)
        rows = np.flatnonzero(h <= U(self.top))
        h = h[rows].astype(np.int64)
        first = self._zero(h - 1) + 1
        start, end = first - h, self._next_zero(first, h) - h
        want = x[rows] & ((_ONE << U(self.low)) - _ONE) if self.low else np.zeros(len(rows), U)
        # values with the same high bits ascend by their low bits: halve the stretch, which is long in a dense range
        stop = end.copy()
        live = np.flatnonzero(start < end)
        while len(live):
            middle = (start[live] + end[live]) >> 1
            less = self._low(middle) < want[live]
            start[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[start[live] < end[live]]
        here = np.flatnonzero(start < stop)
        hit = here[self._low(start[here]) == want[here]]
        out[rows[hit]] = start[hit]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(U)
        first = self.lower[word] >> shift
        second = np.where(shift > 0, self.lower[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (first | second) & ((_ONE << U(self.low)) - _ONE)
