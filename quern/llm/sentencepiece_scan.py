"""Operator 5: SentencePiece encoding and decoding by a max-plus parallel scan.

A text's encoding is the segmentation into vocabulary pieces with the highest sum
of scores (see ``lattice``; the public vocabulary comes without unigram
probabilities and is never trained, so scores follow its ranks by Zipf's law).
Byte pieces spell what has no piece, so decoding gives the text back exactly.

Texts of up to ``GIANT`` characters are encoded where they stand.  Longer ones are
cut into chunks of ``CHUNK`` characters, wherever that falls, and encoded by scans.  At
a chunk's edge the state is how far the last piece reaches over it.

1. A chunk is a max-plus matrix: entry i, j is the best score from overhang i at its
   start to overhang j at its end.
2. Matrices are multiplied in groups of ``FAN``, products again, up to one a text; on
   the way down each chunk gets the best score of every state at its start.
3. With these a chunk knows from which state at its start each state at its end is
   reached: a map of states.  Maps are composed by the same scan, from the end, which
   tells each chunk the state in which it is left.
4. Each chunk is traced back by itself.

Both operations are associative, no task holds more than ``FAN`` matrices or maps, and
the number of passes is the logarithm of the longest text's chunks.  Words inside a
chunk are encoded once and remembered (see ``Chunks``); a chunk that is part of one
endless word gets its matrix and its trace by full passes.

Of segmentations with equal scores the one counts that has the longest last piece, then
the longest before it, and so on: in short texts and in chunks alike, so ids do not
depend on ``GIANT`` or ``CHUNK``.

Defined results: null and empty text have no pieces; repeated rows are encoded alike;
giant texts are told apart by a 64-bit hash of doc_id and text (two of ten million share
one with a probability of 3e-6, which ``text_ok`` would show); other columns do not
matter, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.lattice import LITERAL, SEGMENT, SPACE, Batch, Pieces, codepoints, default_model, load, normalised, piece_bytes, segments, spelled
from quern.llm.memo import Memo, gathered
from quern.llm.textkit import slices, views
from quern.scratch import materialize

GIANT, CHUNK = 32_768, 8_192
#: Segments that a worker remembers, and new ones that are encoded side by side.
REMEMBERED, ABREAST = 200_000, 4_000
#: Neighbours that are combined at once in a scan.
FAN = 64
#: A segment starts.
_START = re.compile(f"(?<!{SPACE}){SPACE}")
NONE = -(1 << 60)
SIDE_BY_SIDE = 48


def encoder(vocabulary: Pieces) -> Memo:
    def make(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= 64]
        for at in range(0, len(short), ABREAST):
            part = short[at : at + ABREAST]
            for k, ids in zip(part, Batch(vocabulary, [texts[k] for k in part]).best(), strict=True):
                out[k] = ids
        out = [x if x is not None else Batch(vocabulary, [t]).best()[0] for x, t in zip(out, texts, strict=True)]
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(n.sum())), n

    return Memo(segments, make, REMEMBERED)


@lru_cache(maxsize=1)
def kept(pieces: tuple[str, ...]) -> tuple[Chunks, Decoder]:
    """What a worker keeps from task to task: remembered segments, for short texts and chunks alike, and a decoder."""
    v = Pieces(list(pieces))
    return Chunks(v), Decoder(v)


class Decoder:
    """Decodes many sequences at once."""

    def __init__(self, vocabulary: Pieces):
        table = piece_bytes(vocabulary)
        self.pool = np.frombuffer(b"".join(table), np.uint8)
        self.lengths = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def same(self, ids: np.ndarray, bounds: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Whether each sequence decodes to its text (null: to nothing)."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[bounds]
        raw, offsets = views(texts)
        n = np.diff(offsets)
        ok = np.diff(ends) == n + (n > 0)  # one space in front of a text
        for r in np.flatnonzero(ok & (n > 0)).tolist():
            made = gathered(self.pool, self.starts, self.lengths, ids[bounds[r] : bounds[r + 1]])
            ok[r] = np.array_equal(made[1:], raw[offsets[r] : offsets[r + 1]])
        return ok


def decode(ids, table: list[bytes]) -> str:
    """The text of a sequence of piece ids."""
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


def matrices(v: Pieces, chunks: list[tuple[str, int]]) -> list[np.ndarray]:
    """Transfer matrix of each chunk (its text with what the next pieces may reach, its own length)."""
    s = v.longest
    out = []
    for k in range(0, len(chunks), SIDE_BY_SIDE):
        part = chunks[k : k + SIDE_BY_SIDE]
        table, ids, starts = _scores(v, part)
        n, width = len(part), max(size for _, size in part)
        sizes = np.array([size for _, size in part])
        best = np.full((n, s, width + 2 * s), NONE, np.int64)
        for i in range(s):
            best[:, i, s + i] = 0  # position 0 stands at index s
        result = np.full((n, s, s), NONE, np.int64)
        for p in range(width):
            live = p < sizes
            for length in range(1, s + 1):
                gain = table[:, length - 1, p]
                if (gain > NONE).any():
                    reach = best[:, :, s + p] + gain[:, None]
                    reach[~live] = NONE
                    np.maximum(best[:, :, s + p + length], reach, out=best[:, :, s + p + length])
        for r in range(n):
            result[r] = np.maximum(best[r, :, s + sizes[r] : 2 * s + sizes[r]], NONE)
        out += list(result)
    return out


def _scores(v: Pieces, part: list[tuple[str, int]]):
    """Scores [chunk, length - 1, position] of the pieces that start in each chunk."""
    cps, starts = codepoints([t for t, _ in part])
    room = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(cps))
    ids = v.lookup(cps, room)
    gains = np.where(ids >= 0, v.scores[ids], NONE)
    gains[0] = np.where(ids[0] >= 0, gains[0], v.unknown)
    width = max(size for _, size in part)
    table = np.full((len(part), v.longest, width), NONE, np.int64)
    for r, (_, size) in enumerate(part):
        table[r, :, :size] = gains[:, starts[r] : starts[r] + size]
    return table, ids, starts


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; works on vectors and matrices."""
    return np.maximum((a[..., :, None] + b).max(axis=-2), NONE)


def product_of(parts: list[bytes]) -> bytes:
    """The product of some neighbours' matrices."""
    s = _side(parts[0])
    out = np.frombuffer(parts[0], np.int64).reshape(s, s)
    for m in parts[1:]:
        out = product(out, np.frombuffer(m, np.int64).reshape(s, s))
    return out.tobytes()


def entries(start: bytes | None, parts: list[bytes]) -> list[bytes]:
    """Best scores of the states at the start of each, from those at the start of all (none: a text's beginning)."""
    s = _side(parts[0])
    at = np.full(s, NONE, np.int64)
    at[0] = 0
    at = at if start is None else np.frombuffer(start, np.int64)
    out = []
    for m in parts:
        out.append(at.tobytes())
        at = product(at, np.frombuffer(m, np.int64).reshape(s, s))
    return out


def _side(matrix: bytes) -> int:
    return round((len(matrix) // 8) ** 0.5)


def composed(parts: list[bytes]) -> bytes:
    """The state at the first's start for each state at the last's end."""
    out = np.frombuffer(parts[-1], np.int32)
    for f in reversed(parts[:-1]):
        out = np.where(out >= 0, np.frombuffer(f, np.int32)[out], np.int32(-1))
    return out.astype(np.int32).tobytes()


def leaves(end: bytes | None, parts: list[bytes]) -> list[bytes]:
    """The state at the end of each, from that at the end of all (none: a text's end)."""
    at = 0 if end is None else int(np.frombuffer(end, np.int32)[0])
    out = []
    for f in reversed(parts):
        out.append(np.int32(at).tobytes())
        at = int(np.frombuffer(f, np.int32)[at])
    return out[::-1]


def scan(rows: DataFrame, combine: Callable, spread: Callable) -> DataFrame:
    """(k, i, y) from (k, i, x): what ``spread`` gives each chunk of a text, by a tree of FAN branches a node."""
    levels = [rows]
    most = rows.agg(F.max("i")).first()[0] or 0

    def groups(level: DataFrame) -> DataFrame:
        return level.groupBy("k", F.floor(F.col("i") / FAN).alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("steps"))

    def up(batches):
        for batch in batches:
            made = [combine([x["x"] for x in steps]) for steps in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["k", "i", "x"])

    def down(batches):
        for batch in batches:
            k, i, y = [], [], []
            for key, steps, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                k += [key] * len(steps)
                i += [x["i"] for x in steps]
                y += spread(start, [x["x"] for x in steps])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int64()), pa.array(y, pa.binary())], names=["k", "i", "y"])

    while most >= FAN:
        levels.append(materialize(groups(levels[-1]).mapInArrow(up, "k long, i long, x binary"), "scan"))
        most //= FAN
    got = None
    for level in reversed(levels):
        nodes = groups(level)
        if got is None:
            nodes = nodes.select("k", "steps", F.lit(None).cast("binary").alias("y"))
        else:
            nodes = nodes.join(got.withColumnRenamed("i", "g"), ["k", "g"]).select("k", "steps", "y")
        got = nodes.mapInArrow(down, "k long, i long, y binary")
    return got


def forward(v: Pieces, text: str, size: int, entry: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """(last piece's length by place, state of entry by place, pieces) over a chunk from the scores of its states.

    Length 0: the place is reached from the chunk before.  Of equal scores the longest last piece counts, and what
    comes from the chunk before is longer than any piece of this one.
    """
    s = v.longest
    table, ids, _ = _scores(v, [(text, size)])
    gains = table[0].T.tolist()
    best, back, label = [NONE] * (size + 2 * s), [0] * (size + 2 * s), [-1] * (size + 2 * s)
    for p, x in enumerate(entry.tolist()):
        if x > NONE:
            best[p], label[p] = x, p
    for p in range(size):
        here = best[p]
        if here > NONE:
            for length, gain in enumerate(gains[p], 1):
                if gain > NONE and here + gain > best[p + length]:
                    best[p + length], back[p + length], label[p + length] = here + gain, length, label[p]
    return back, label, ids


def traced(v: Pieces, text: str, size: int, entry: np.ndarray, leave: int) -> list[int]:
    """Pieces of one chunk from the scores of its states to the state in which it is left."""
    back, _, ids = forward(v, text, size, entry)
    end, places, found = size + leave, [], []
    while back[end]:
        length = back[end]
        end -= length
        places.append(end)
        found.append(int(ids[length - 1, end]))
    return spelled(v, found[::-1], text, places[::-1])


class Chunks:
    """Matrices and traces of chunks, with segments inside remembered.

    No piece reaches over a segment's start.  Between a chunk's first and last segment start the best score is a
    constant, the sum of its segments' scores, so the matrix of a chunk that has one is a column (from each overhang
    to the first start) plus that constant plus a row (from the last start to each overhang).
    """

    def __init__(self, v: Pieces):
        self.v, self.memory = v, encoder(v)
        self.found = dict(zip((v.pieces[i] for i in v.ids.tolist()), v.ids.tolist(), strict=True))
        scores = v.scores.copy()
        lead = [k for b, k in enumerate(v.bytes.tolist()) if k >= 0 and b & 0xC0 != 0x80]
        scores[lead] = v.unknown  # a spelled character counts once
        self.scores = scores

    @staticmethod
    def starts(text: str, size: int) -> tuple[int, int] | None:
        """First and last segment start within the chunk (at 1 to its size)."""
        first = next((m.start() for m in _START.finditer(text, 1, size + 1)), None)
        if first is None:
            return None
        last = max(text.rfind(SPACE, 0, size + 1), first)
        while text[last - 1] == SPACE:
            last -= 1
        return first, max(last, first)

    def _steps(self, text: str, at: int):
        """(length, id, score) of the pieces that start at a place."""
        for n in range(1, self.v.longest + 1):
            if at + n > len(text):
                return
            i = self.found.get(text[at : at + n])
            if i is not None:
                yield n, i, int(self.v.scores[i])
            elif n == 1:
                yield 1, -1, self.v.unknown

    def _forward(self, text: str, begin: dict[int, int], end: int):
        """Best scores and last steps of the places that are reached from those of ``begin`` by pieces before ``end``.

        Ties as in ``forward``.
        """
        best, back = dict(begin), {}
        for p in range(min(begin, default=end), end):
            if p in best:
                for n, i, gain in self._steps(text, p):
                    if best[p] + gain > best.get(p + n, NONE):
                        best[p + n], back[p + n] = best[p] + gain, (n, i)
        return best, back

    def _path(self, text: str, end: int, back: dict) -> tuple[list[int], int]:
        """(pieces, place where they begin)."""
        ids, places = [], []
        while end in back:
            n, i = back[end]
            end -= n
            ids.append(i)
            places.append(end)
        return spelled(self.v, ids[::-1], text, places[::-1]), end

    def _head(self, text: str, first: int, entry: np.ndarray) -> tuple[list[int], int]:
        """(pieces before the first segment start, state of entry)."""
        begin = {p: x for p, x in enumerate(entry[: first + 1].tolist()) if x > NONE}
        return self._path(text, first, self._forward(text[:first], begin, first)[1])

    def matrices(self, chunks: list[tuple[str, int]]) -> list[np.ndarray]:
        s = self.v.longest
        cuts = [self.starts(t, n) for t, n in chunks]
        whole = [c for c, k in zip(chunks, cuts, strict=True) if k is None]
        rest = iter(matrices(self.v, whole) if whole else [])
        inner, bounds = self.memory.encode_segments([SEGMENT.findall(t[k[0] : k[1]]) if k else [] for (t, _), k in zip(chunks, cuts, strict=True)])
        sums = np.concatenate([[0], np.cumsum(self.scores[inner])])[bounds]
        out = []
        for (text, size), k, middle in zip(chunks, cuts, np.diff(sums).tolist(), strict=True):
            if k is None:
                out.append(next(rest))
                continue
            first, last = k
            column = np.full(s, NONE, np.int64)
            tail = {first: 0}
            for p in range(first - 1, -1, -1):
                tail[p] = max((gain + tail[p + n] for n, _, gain in self._steps(text[:first], p) if p + n in tail), default=NONE)
            for i in range(min(s, first + 1)):
                column[i] = tail[i]
            row = np.full(s, NONE, np.int64)
            best, _ = self._forward(text, {last: 0}, size)
            for j in range(s):
                row[j] = best.get(size + j, NONE)
            out.append(np.maximum(column[:, None] + middle + row[None, :], NONE))
        return out

    def maps(self, chunks: list[tuple[str, int, np.ndarray]]) -> list[np.ndarray]:
        """Of each chunk (text, size, scores of its states) the state of entry for each state in which it may be left.

        Whatever follows a segment start, the path to it is the same.
        """
        out = []
        for text, size, entry in chunks:
            k = self.starts(text, size)
            if k is None:
                out.append(np.array(forward(self.v, text, size, entry)[1][size : size + self.v.longest], np.int32))
            else:
                out.append(np.full(self.v.longest, self._head(text, k[0], entry)[1], np.int32))
        return out

    def traces(self, chunks: list[tuple[str, int, np.ndarray, int]]) -> list[list[int]]:
        """Pieces of each chunk (text, size, scores of its states, state in which it is left)."""
        cuts = [self.starts(t, n) for t, n, _, _ in chunks]
        inner, bounds = self.memory.encode_segments([SEGMENT.findall(c[0][k[0] : k[1]]) if k else [] for c, k in zip(chunks, cuts, strict=True)])
        out = []
        for r, ((text, size, entry, leave), k) in enumerate(zip(chunks, cuts, strict=True)):
            if k is None:
                out.append(traced(self.v, text, size, entry, leave))
                continue
            first, last = k
            ids = self._head(text, first, entry)[0] + inner[bounds[r] : bounds[r + 1]].tolist()
            _, back = self._forward(text, {last: 0}, size)
            out.append(ids + self._path(text, size + leave, back)[0])
        return out


def _pack(k: pa.Array, texts: pa.Array, longest: int):
    for key, text in zip(k.to_pylist(), texts.to_pylist(), strict=True):
        full = normalised(text)
        n = (len(full) + CHUNK - 1) // CHUNK
        for i in range(n):
            part = full[i * CHUNK : (i + 1) * CHUNK + longest]
            # the stand-in for a literal ▁ is no UTF-8, so parts travel as bytes
            yield key, i, part.encode("utf-8", "surrogatepass"), min(CHUNK, len(full) - i * CHUNK)


def _chunks(longest: int):
    def run(batches):
        for batch in batches:
            rows = []
            for row in _pack(batch.column(0), batch.column(1), longest):
                rows.append(row)
                if len(rows) == 256:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)

    def _table(rows):
        k, i, part, size = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int64()), pa.array(part, pa.binary()), pa.array(size, pa.int32())], names=["k", "i", "part", "size"])

    return run


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text_ok): piece ids of each text; text_ok tells whether they decode to it."""
    v = load(model or default_model())
    table, pieces = piece_bytes(v), tuple(v.pieces)
    rows = documents.select("doc_id", "text")
    small = F.coalesce(F.char_length("text") <= GIANT, F.lit(True))
    schema = "doc_id long, ids array<int>, text_ok boolean"

    def whole(batches):
        chunks, decoder = kept(pieces)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, bounds = chunks.memory.encode(part.column(1).to_pylist())
                ok = decoder.same(ids, bounds, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(ok)], names=["doc_id", "ids", "text_ok"])

    def matrix(batches):
        chunks, _ = kept(pieces)
        for part in _parts(batches):
            made = chunks.matrices(_texts(part))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m.tobytes() for m in made], pa.binary())], names=["k", "i", "x"])

    def mapped(batches):
        chunks, _ = kept(pieces)
        for part in _parts(batches):
            made = chunks.maps([(t, n, y) for (t, n), y in zip(_texts(part), _vectors(part.column(4)), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(4), pa.array([m.tobytes() for m in made], pa.binary())], names=["k", "i", "entry", "x"])

    def trace(batches):
        chunks, _ = kept(pieces)
        for part in _parts(batches):
            end = [int(np.frombuffer(y, np.int32)[0]) for y in part.column(5).to_pylist()]
            ids = chunks.traces([(t, n, y, e) for (t, n), y, e in zip(_texts(part), _vectors(part.column(4)), end, strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["k", "i", "ids"])

    def checked(batches):
        for batch in batches:
            ok = [decode(x, table) == t for x, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["doc_id", "ids", "text_ok"])

    giants = rows.where(~small).withColumn("k", F.xxhash64("doc_id", "text"))
    chunks = giants.dropDuplicates(["k"]).select("k", "text").mapInArrow(_chunks(v.longest), "k long, i long, part binary, size int")
    chunks = materialize(chunks.repartition("k", "i"), "chunks", "zstd")
    steps = materialize(chunks.mapInArrow(matrix, "k long, i long, x binary"), "matrices", "zstd")
    entry = scan(steps, product_of, entries)
    maps = chunks.join(entry, ["k", "i"]).select("k", "i", "part", "size", "y").mapInArrow(mapped, "k long, i long, entry binary, x binary")
    maps = materialize(maps, "maps", "zstd")
    ends = scan(maps.select("k", "i", "x"), composed, leaves).join(maps.select("k", "i", "entry"), ["k", "i"])
    parts = chunks.join(ends, ["k", "i"]).select("k", "i", "part", "size", "entry", "y").mapInArrow(trace, "k long, i long, ids array<int>")
    joined = parts.groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))
    large = giants.join(joined, "k").select("doc_id", "ids", "text").mapInArrow(checked, schema)
    return rows.where(small).mapInArrow(whole, schema).union(large)


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SIDE_BY_SIDE):
            yield batch.slice(at, SIDE_BY_SIDE)


def _texts(part: pa.RecordBatch) -> list[tuple[str, int]]:
    return [(p.decode("utf-8", "surrogatepass"), n) for p, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def encoded(documents: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids, text_ok)."""
    return encode(documents, model).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text_ok")


__all__ = ["LITERAL", "SPACE", "Chunks", "Decoder", "composed", "decode", "encode", "encoded", "encoder", "entries", "leaves", "matrices", "product", "product_of", "scan", "traced"]
