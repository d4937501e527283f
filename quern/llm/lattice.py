"""Segmentations of text over a fixed piece vocabulary.

A text is taken as ``▁`` + text with spaces as ``▁``.  No piece holds a ``▁``
after another character, so a text falls into segments (``▁``s and the characters
up to the next ``▁``) that can be treated apart; equal segments are treated once.
Characters without a piece are spelled in byte pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from quern.llm.textkit import U, mix

SPACE = "▁"
#: Stands for a literal ▁, which is no space: a lone surrogate, which no UTF-8 text has.
LITERAL = "\ud800"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
BITS = 20


def default_model() -> str:
    """The public SentencePiece vocabulary of this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary that can be looked up for all substrings of many texts at once.

    Scores are fixed by rank (a piece's place in the vocabulary): Zipf's law gives
    the r-th piece a probability in proportion to 1 / r.  They are integers
    (2**-20 of a nat), so that sums agree however they are grouped.
    """

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.bytes = np.full(256, -1, np.int32)
        for k, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                self.bytes[int(p[3:5], 16)] = k
        first = int(self.bytes.max()) + 1
        plain = np.array([k for k, p in enumerate(pieces) if k >= first and p], np.int32)
        self.size = len(pieces)
        self.longest = max((len(pieces[k]) for k in plain), default=1)
        logs = np.log(1 + np.arange(len(pieces) - first, dtype=float))
        total = np.log(np.exp(-logs).sum())
        self.scores = np.zeros(len(pieces), np.int64)
        self.scores[first:] = np.round(-(logs + total) * (1 << 20)).astype(np.int64)
        #: Of a character without a piece: lower than any piece's.
        self.unknown = int(self.scores.min()) - (10 << 20)
        cps, starts = codepoints([pieces[k] for k in plain])
        h = Substrings(cps).hash(starts[:-1], np.diff(starts))
        order = np.argsort(h)
        self.hash, self.ids = h[order], plain[order]
        #: By the first bits of a hash: its place among the sorted ones, -1 for none, -2 where several share them.
        slot, first, times = np.unique((self.hash >> U(64 - BITS)).astype(np.int64), return_index=True, return_counts=True)
        self.slots = np.full(1 << BITS, -1, np.int32)
        self.slots[slot] = np.where(times == 1, first, -2)

    def lookup(self, cps: np.ndarray, room: np.ndarray) -> np.ndarray:
        """ids[l - 1, i]: the piece of l characters at i, or -1; room[i]: characters from i to the segment's end."""
        subs, n = Substrings(cps), len(cps)
        out = np.full((self.longest, n), -1, np.int32)
        for length in range(1, self.longest + 1):
            at = np.flatnonzero(room >= length)
            h = subs.hash(at, length)
            k = self.slots[(h >> U(64 - BITS)).astype(np.int64)]
            some = np.flatnonzero(k != -1)
            h, k = h[some], k[some].astype(np.int64)
            shared = np.flatnonzero(k == -2)
            k[shared] = np.minimum(np.searchsorted(self.hash, h[shared]), len(self.hash) - 1)
            hit = self.hash[k] == h
            out[length - 1, at[some[hit]]] = self.ids[k[hit]]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Pieces([model.id_to_piece(k) for k in range(model.get_piece_size())])


class Substrings:
    def __init__(self, cps: np.ndarray):
        n = len(cps)
        power = np.full(n + 1, U(_BASE))
        power[0] = U(1)
        inverse = np.full(n + 1, U(_INV))
        inverse[0] = U(1)
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((cps.astype(U) + U(1)) * np.multiply.accumulate(power)[:n], out=self.sums[1:])

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.inverse[at] ^ (np.asarray(length).astype(U) * U(0xD6E8FEB86659FD93)))


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each starts and the last ends)."""
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return cps, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def normalised(text: str | None) -> str:
    """One ``▁`` in front and for each space; a literal ▁ becomes ``LITERAL``."""
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""


def spell(char: str) -> bytes:
    return SPACE.encode() if char == LITERAL else char.encode("utf-8", "surrogatepass")


def segments(text: str | None) -> list[str]:
    return SEGMENT.findall(normalised(text))


class Batch:
    """Many segments side by side, longest first, so that a step serves all that reach it."""

    def __init__(self, vocabulary: Pieces, texts: list[str]):
        self.texts, self.vocabulary = texts, vocabulary
        lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.cps, self.starts = codepoints([texts[k] for k in self.order])
        ends = np.repeat(self.starts[1:], self.lengths)
        self.ids = vocabulary.lookup(self.cps, ends - np.arange(len(self.cps)))
        self.steps = int(self.lengths[0]) if len(texts) else 0
        #: how many segments have at least p characters
        self.reach = np.searchsorted(-self.lengths, -np.arange(self.steps + 1), side="right")

    def best(self) -> list[list[int]]:
        """Pieces of a segmentation with the highest score, for each text in the order given.

        Ties: the longest last piece, from the end.
        """
        v = self.vocabulary
        width = self.steps + 1
        n = len(self.texts)
        if not n:
            return []
        score = np.full((width, n), -(1 << 60), np.int64)
        score[0] = 0
        back = np.zeros((width, n), np.int8)
        for p in range(1, width):
            m = int(self.reach[p])
            top, choice = np.full(m, -(1 << 60), np.int64), np.zeros(m, np.int8)
            for length in range(1, min(p, v.longest) + 1):
                ids = self.ids[length - 1, self.starts[:m] + p - length]
                gain = np.where(ids >= 0, v.scores[ids], v.unknown if length == 1 else -(1 << 60))
                gain = gain + score[p - length, :m]
                better = gain >= top
                top[better], choice[better] = gain[better], length
            score[p, :m], back[p, :m] = top, choice
        at = self.lengths.copy()
        rows, places, found = [], [], []
        live = np.flatnonzero(at > 0)
        while len(live):
            length = back[at[live], live]
            at[live] -= length
            rows.append(live)
            places.append(at[live])
            found.append(self.ids[length.astype(np.int64) - 1, self.starts[live] + at[live]])
            live = live[at[live] > 0]
        if not rows:
            return [[] for _ in range(n)]
        rows, places, found = np.concatenate(rows), np.concatenate(places), np.concatenate(found)
        order = np.lexsort((places, rows))
        rows, places, found = rows[order], places[order], found[order]
        cut = np.searchsorted(rows, np.arange(n + 1)).tolist()
        flat = found.tolist()
        out: list = [None] * n
        for o, a, b in zip(self.order.tolist(), cut[:-1], cut[1:], strict=True):
            out[o] = flat[a:b]
        for k in np.unique(rows[found < 0]).tolist():
            a, b = cut[k], cut[k + 1]
            out[self.order[k]] = spelled(v, flat[a:b], self.texts[self.order[k]], places[a:b].tolist())
        return out


def spelled(v: Pieces, ids: list[int], text: str, places: list[int]) -> list[int]:
    """Byte pieces in place of characters without a piece."""
    parts: list[int] = []
    for i, at in zip(ids, places, strict=True):
        parts += [i] if i >= 0 else v.bytes[list(spell(text[at]))].tolist()
    return parts


def piece_bytes(v: Pieces) -> list[bytes]:
    """What each piece stands for in UTF-8."""
    back = {int(k): bytes([b]) for b, k in enumerate(v.bytes.tolist()) if k >= 0}
    return [back.get(k) or p.replace(SPACE, " ").encode() for k, p in enumerate(v.pieces)]
