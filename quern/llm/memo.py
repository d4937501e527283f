"""Encoding by segments, each distinct one once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

CACHE = 300_000
#: Codes that the remembered segments may take together.
POOL = 16 << 20


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """pool[starts[w]:starts[w] + lengths[w]] for each w, one after another."""
    n = lengths[which]
    shift = starts[which] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    return pool[np.arange(n.sum()) + np.repeat(shift, n)]


class Growing:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.held):
            wide = np.empty(max(need, 2 * len(self.held)), self.held.dtype)
            wide[: self.n] = self.held[: self.n]
            self.held = wide
        self.held[self.n : need] = more
        self.n = need

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Memo:
    """Encodes texts whose code is that of their segments, one after another.

    ``cut`` gives a text's segments and ``make`` the codes of new ones and how many each has.  Beyond ``cache``
    segments or ``POOL`` codes those used least are forgotten, so memory stays bounded.
    """

    def __init__(self, cut: Callable[[str], list[str]], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cache: int = CACHE):
        self.cut, self.make, self.cache = cut, make, cache
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.lengths, self.uses = Growing(np.int32), Growing(np.int64), Growing(np.int64), Growing(np.int64)

    def thin(self) -> None:
        """Keep the third of the segments that were used most, and halve their counts."""
        names, uses = list(self.known), self.uses.all
        kept = np.sort(np.argsort(-uses, kind="stable")[: min(self.cache, len(names)) // 3])
        kept = kept[np.cumsum(self.lengths.all[kept]) <= POOL // 2]
        pool, lengths, uses = gathered(self.pool.all, self.starts.all, self.lengths.all, kept), self.lengths.all[kept], uses[kept] // 2
        self.forget()
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.pool.extend(pool)
        self.lengths.extend(lengths)
        self.starts.extend(np.cumsum(lengths) - lengths)
        self.uses.extend(uses)

    def learn(self, fresh: list[str]) -> None:
        codes, n = self.make(fresh)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.starts.extend(self.pool.n + np.cumsum(n) - n)
        self.lengths.extend(n)
        self.uses.extend(np.zeros(len(n), np.int64))
        self.pool.extend(codes)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, bounds): those of text r at bounds[r]:bounds[r + 1]; null has none.

        Only one text's segments stand as Python strings at a time.
        """
        try:
            cut = [pa.array(self.cut(t) if t else [], pa.large_string()) for t in texts]
        except UnicodeEncodeError:
            return self.encode_segments([self.cut(t) if t else [] for t in texts])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = pa.concat_arrays(cut or [pa.array([], pa.large_string())])
        del cut
        return self.encode_array(flat.dictionary_encode(), n)

    def encode_segments(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that are cut already."""
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        try:
            flat = pa.array(chain.from_iterable(cut), pa.large_string(), size=int(n.sum())).dictionary_encode()
        except UnicodeEncodeError:  # a lone surrogate is no UTF-8
            at: dict[str, int] = {}
            which = np.fromiter((at.setdefault(s, len(at)) for s in chain.from_iterable(cut)), np.int64, int(n.sum()))
            return self._coded(list(at), which, n)
        return self.encode_array(flat, n)

    def encode_array(self, segments: pa.DictionaryArray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the segments of all texts, n[r] of text r; only distinct ones become Python strings."""
        return self._coded(segments.dictionary.to_pylist(), segments.indices.to_numpy().astype(np.int64), n)

    def _coded(self, distinct: list[str], which: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.cache or self.pool.n > POOL:
            self.thin()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = len(self.known) + np.arange(len(fresh))
            self.learn([distinct[k] for k in fresh.tolist()])
        self.uses.all[place] += np.bincount(which, minlength=len(distinct))
        starts, lengths = self.starts.all[place], self.lengths.all[place]
        ends = np.concatenate([[0], np.cumsum(lengths[which])])
        return gathered(self.pool.all, starts, lengths, which), ends[np.concatenate([[0], np.cumsum(n)])]
