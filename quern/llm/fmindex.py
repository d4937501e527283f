"""An FM-index over sequences of symbols, searched for many patterns at a time.

The rows of the index are the places of the text, ordered by the ``depth`` symbols that
begin there.  The symbol before each row's place stands in a wavelet matrix (one bit
vector per bit of a symbol, with counts of ones every 64 bits), so a pattern of up to
``depth`` symbols is found from its last symbol to its first with two rank queries a
symbol.  Rows that agree in ``depth - 1`` symbols are marked: a window that has been found
is widened to these before it takes the symbol on its left, so the next window costs one
step and not ``depth``.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE = U(1)


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(64 - len(bits) % 64, bool)]), bitorder="little")
        self.words = packed.view(U)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.ones[word] + np.bitwise_count(self.words[word] & ((_ONE << (at & 63).astype(U)) - _ONE))


class WaveletMatrix:
    """Symbols below ``size``, with the number of each before a place."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        self.starts = np.zeros(size, np.int64)
        every = np.arange(size)
        for shift in reversed(range(max(1, (size - 1).bit_length()))):
            ones = (symbols >> shift) & 1 == 1
            bits = Bits(ones)
            zeros = int(len(ones) - ones.sum())
            before = bits.rank(self.starts)
            self.starts = np.where((every >> shift) & 1 == 1, zeros + before, self.starts - before)
            self.levels.append((shift, bits, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for shift, bits, zeros in self.levels:
            before = bits.rank(at)
            at = np.where((symbols >> shift) & 1 == 1, zeros + before, at - before)
        return at - self.starts[symbols]


class FMIndex:
    """Of texts of symbols 1 and more, each followed by a 0; no pattern holds a 0."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        n, size = len(text), int(text.max(initial=0)) + 1
        near = _agreeing(text, depth - 1)
        full = _paired(near, text, depth - 1)
        self.order = np.argsort(full, kind="stable")
        self.before = WaveletMatrix(text[self.order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        near = near[self.order]
        turns = np.concatenate([[True], near[1:] != near[:-1]]) if n else np.empty(0, bool)
        self.group = (np.cumsum(turns) - 1).astype(np.int32)
        self.bounds = np.append(np.flatnonzero(turns), n)

    def extended(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``symbol + pattern`` from the rows of each pattern."""
        at = self.smaller[symbols]
        return at + self.before.rank(symbols, lo), at + self.before.rank(symbols, hi)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (lo, hi) of each row of ``patterns``, which have at most ``depth`` symbols."""
        last = patterns[:, -1]
        lo, hi = self.smaller[last], self.smaller[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            lo, hi = self.extended(patterns[:, k], lo, hi)
        return lo, hi

    def shortened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each window of ``depth`` symbols without its last one."""
        g = self.group[lo]
        return self.bounds[g], self.bounds[g + 1]

    def first(self, lo: np.ndarray) -> np.ndarray:
        """Where in the text the first row of each window of ``depth`` symbols begins: rows that agree stand in text order."""
        return self.order[lo]


def _paired(ranks: np.ndarray, others: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of (rank of a place, other rank ``shift`` places on)."""
    moved = np.zeros_like(others)
    moved[: max(0, len(others) - shift)] = others[shift:]
    return np.unique(ranks.astype(np.int64) * (int(others.max(initial=0)) + 1) + moved, return_inverse=True)[1]


def _agreeing(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of places by the ``depth`` symbols that begin there; zeros follow the end."""
    ranks, have = text, 1
    while have * 2 <= depth:
        ranks, have = _paired(ranks, ranks, have), have * 2
    return _paired(ranks, ranks, depth - have) if have < depth else ranks
