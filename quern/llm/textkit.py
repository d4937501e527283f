"""Vectorised words, shingles and hashes over Arrow string columns.

Hashes are 64-bit and depend on bytes alone, so they agree between tasks,
executors and runs.  Work proceeds in blocks of about ``BLOCK`` bytes; a longer
text is cut only between words, so memory follows the block (or the longest
single word), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_INV = pow(_BASE, -1, 1 << 64)
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))

#: Kinds of bytes: a word is a run of one kind that is not 0.
SPACES = np.ones(256, np.uint8)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
ALNUM = np.zeros(256, np.uint8)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = 1
#: Letters and digits, other marks, white space apart.
MARKS = np.where(ALNUM == 1, 1, 2).astype(np.uint8)
MARKS[SPACES == 0] = 0
#: The lower case of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        n = max(n, BLOCK + 4096)
        have = np.full(n, U(base & (2**64 - 1)))
        have[0] = U(1)
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK:
            _powers[name] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (the splitmix64 finaliser)."""
    h = h ^ (h >> U(30))
    h = h * _MIX[0]
    h ^= h >> U(27)
    h *= _MIX[1]
    h ^= h >> U(31)
    return h


def views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes; one row at least.

    At the end what the arrays of the ranges took goes back to the system.
    """
    _, offsets = views(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
    trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can; a worker would keep it otherwise."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)
    pa.default_memory_pool().release_unused()


class Words:
    """Words of some texts: hash, row, and byte range of each, in order."""

    __slots__ = ("hash", "row", "start", "end", "data", "n_rows")

    def __init__(self, column: pa.Array, table: np.ndarray = SPACES, lower: bool = True):
        raw, offsets = views(column)
        self.n_rows = len(offsets) - 1
        self.data = LOWER[raw] if lower else raw
        parts = [self._block(a, b, offsets, table) for a, b in _cuts(raw, table)] or [(np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))]
        self.hash, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.row = np.searchsorted(offsets, self.start, side="right") - 1

    def _block(self, a: int, b: int, offsets: np.ndarray, table: np.ndarray):
        data = self.data[a:b]
        kind = table[data]
        inside = kind != 0
        turn = kind[1:] != kind[:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= turn
        last[:-1] &= turn
        lo, hi = np.searchsorted(offsets, [a, b])
        bounds = offsets[lo : hi + 1]
        bounds = bounds[(bounds > a) & (bounds < b)] - a
        first[bounds] = inside[bounds]
        last[bounds - 1] = inside[bounds - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(b - a + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _power(_BASE, "base", b - a)[: b - a], out=sums[1:])
        h = (sums[e] - sums[s]) * _power(_INV, "inv", b - a)[s]
        return mix(h ^ ((e - s).astype(U) * U(0xD6E8FEB86659FD93))), s + a, e + a

    def texts(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)


def _cuts(raw: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Block bounds that split no word."""
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + BLOCK)
        while b < n and table[raw[b - 1]] and table[raw[b]] == table[raw[b - 1]]:
            step = table[raw[b : b + 4096]]
            stop = np.flatnonzero(step != table[raw[b - 1]])
            b += int(stop[0]) if len(stop) else len(step)
        yield a, b
        a = b


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds): hashes of all runs of ``width`` words, those of row r at bounds[r]:bounds[r + 1].

    A row with fewer words, but not none, has one run: all its words.
    """
    n = words.counts()
    ends = np.concatenate([[0], np.cumsum(n)])
    w = words.hash
    if len(w) >= width:
        h = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            h *= U(0xC2B2AE3D27D4EB4F)
            h += w[k : len(w) - width + 1 + k]
        h = mix(h)
        same = words.row[: len(h)] == words.row[width - 1 :]
        h = h[same]
    else:
        h = np.empty(0, U)
    full = np.maximum(n - width + 1, 0)
    short = np.flatnonzero((n > 0) & (n < width))
    if not len(short):
        return h, np.concatenate([[0], np.cumsum(full)])
    made = full.copy()
    made[short] = 1
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(bounds[-1], U)
    mask = np.ones(bounds[-1], bool)
    mask[bounds[short]] = False
    out[mask] = h
    for r in short.tolist():
        x = U(int(n[r]))
        with np.errstate(over="ignore"):
            for v in w[ends[r] : ends[r + 1]]:
                x = x * U(0xC2B2AE3D27D4EB4F) + v
        out[bounds[r]] = mix(np.array([x]) ^ U(0x5851F42D4C957F2D))[0]
    return out, bounds
