"""Operator 9: language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds every training token's hash and exact count; a token's id is its rank
there.  An entry of level n is (rank of its context in level n - 1, id of its last
token), so an n-gram is found by a successor search among its context's entries
alone: the entries of a context are one stretch of the level's ascending sequence
``rank << bits | id``, and Elias-Fano high bits lead straight to the place in it.
Levels are cut by key ranges into files of flat arrays, which scoring tasks map
into memory; values are quantised to bytes (a 32nd of a decimal order down to 1e-6, an
eighth down to 1e-14).

Probabilities are smoothed by interpolated absolute discounting over all entries
(``least`` occurrences or more, 1 unless told): an n-gram's discounted share of its
context, plus what the context leaves over times the probability one order lower;
level 1 adds one to each count, and one for the unknown.

Counting: tasks reduce their own n-grams to sorted distinct keys, and only deltas of
these, in compressed planes, are shuffled, each to the range of keys that becomes one
file.  Ranges follow the counts of the level below: about ``PER_FILE`` tokens each, and
a context with more is cut at last tokens, by the words' own counts, so a frequent
context is spread over many files.  What is left over of a context is a byte beside the
file's entries; of the contexts at a file's edges the driver adds up the parts (two rows
a file).  Counts cover all training documents.

A key holds a context's rank and a word's id in 64 bits; a corpus for which these do not
suffice is refused before anything is counted.  Files lie in the shared folder, are
written whole under a name that a repeated task writes again, and so survive lost
executors.

Defined results: null and empty texts have one token, their end; with no training
documents every token has probability 1; equal texts have equal scores; other
columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import eliasfano, sharedfiles
from quern.llm.textkit import U, Words, mix, slices
from quern.scratch import discard, materialize, new_path

END = U(0x5EED0FE4D7EC5A11)
SIGN = U(1 << 63)
DISCOUNT, STEPS = 0.75, 32
FLUSH = 2_000_000
PER_FILE = 2_000_000
#: Points at which the words' counts are cut to split a frequent context.
CUTS = 1 << 14
#: Bytes of text taken together: equal n-grams in it are looked up once.
WIDE = 4 << 20
#: Decimal orders that a byte stands for.
ORDERS = np.concatenate([np.arange(192) / STEPS, 6 + np.arange(64) / 8])
POWERS = 10.0**-ORDERS


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): words of each text and its end."""
    w = Words(texts)
    n = w.counts()
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(bounds[-1], END)
    mask = np.ones(len(out), bool)
    mask[bounds[1:] - 1] = False
    out[mask] = w.hash
    return out, bounds


class Level:
    """The parts of a level, searched together."""

    def __init__(self, parts: list[tuple[int, int, str]]):
        """parts: (first key, entries, file), ascending."""
        self.parts = parts
        self.firsts = np.array([p[0] for p in parts], U)
        self.bases = np.concatenate([[0], np.cumsum([p[1] for p in parts])]).astype(np.int64)
        self.files: dict[int, dict] = {}

    def _file(self, k: int):
        if k not in self.files:
            arrays = sharedfiles.load(self.parts[k][2])
            self.files[k] = (eliasfano.Sequence(arrays), arrays)
        return self.files[k]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key, -1 where there is none; keys ascend."""
        out = np.full(len(keys), -1, np.int64)
        cuts = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for k in range(len(self.parts)):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                at = self._file(k)[0].find(keys[a:b])
                out[a:b] = np.where(at >= 0, at + self.bases[k], -1)
        return out

    def values(self, name: str, ranks: np.ndarray) -> np.ndarray:
        """An entry's value for each rank, which ascend."""
        out = np.zeros(len(ranks), np.int64)
        cuts = np.searchsorted(ranks, self.bases)
        for k in range(len(self.parts)):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                out[a:b] = self._file(k)[1][name][ranks[a:b] - self.bases[k]]
        return out

    def looked_up(self, keys: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys' ranks, place of each row among them, ranks by row); rows not ok have rank -1."""
        distinct, back = np.unique(keys[ok], return_inverse=True)
        found = self.find(distinct)
        ranks = np.full(len(keys), -1, np.int64)
        ranks[ok] = found[back]
        return found, back, ranks


class Rests:
    """What each context leaves over, a byte each by its rank; 0, that is everything, where nothing follows it."""

    def __init__(self, level: Level, spans: list[tuple[int, int]], edges: dict[int, int]):
        """spans: first and last context of each of the level's files; edges: bytes of the contexts at the spans' ends."""
        self.level = level
        self.first, self.last = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
        self.edge = np.array(sorted(edges), np.int64)
        self.byte = np.array([edges[k] for k in sorted(edges)], np.uint8)

    def values(self, ranks: np.ndarray) -> np.ndarray:
        """For each rank, which ascend; 0 for rank -1, wherever it stands."""
        out = np.zeros(len(ranks), np.uint8)
        some = np.flatnonzero(ranks >= 0)
        asked = ranks[some]
        # a context at two files' edges is in both and among the edges
        low, high = np.searchsorted(asked, self.first), np.searchsorted(asked, self.last, side="right")
        for k in np.flatnonzero(low < high).tolist():
            out[some[low[k] : high[k]]] = self.level._file(k)[1]["rest"][asked[low[k] : high[k]] - self.first[k]]
        if len(self.edge) and len(asked):
            at = np.minimum(np.searchsorted(asked, self.edge), len(asked) - 1)
            met = np.flatnonzero(asked[at] == self.edge)
            out[some[at[met]]] = self.byte[met]
        return out


def _levels(directory):
    return [Level(p) for p in directory]


def _ranks(hashes: np.ndarray, bounds: np.ndarray, levels: list[Level], bits: int) -> list[np.ndarray]:
    """For each level n the rank of the n-gram that ends at each token, -1 without one."""
    out = [levels[0].looked_up(hashes ^ SIGN, np.ones(len(hashes), bool))[2]]
    for n, level in enumerate(levels[1:], 2):
        context = _context(out[-1], bounds, out[0], n)
        ok = (context >= 0) & (out[0] >= 0)
        out.append(level.looked_up(_key(context, out[0], bits), ok)[2])
    return out


def _context(ranks: np.ndarray, bounds: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Rank of the context of each token for level n: the n-gram one order lower that ends before it."""
    context = np.empty_like(ranks)
    context[1:] = ranks[:-1]
    # every text begins after an end
    context[bounds[:-1]] = ids[bounds[1:] - 1] if n == 2 else -1
    return context


def _key(context: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    return (np.maximum(context, 0).astype(U) << U(bits)) | np.maximum(ids, 0).astype(U)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _planes(a: np.ndarray) -> bytes:
    wide = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, wide).T).tobytes())


def _flat(raw: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(wide, -1).T).view(kind).ravel()


def _count_words(batches):
    keys, counts, held = [], [], 0

    def rows():
        k, c = _merged(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["h", "c"])

    for batch in batches:
        for i, j in slices(batch.column(0), WIDE):
            k, c = np.unique(tokens(batch.column(0).slice(i, j - i))[0], return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.int64))
            held += len(k)
            if held > FLUSH:
                k, c = _merged(keys, counts)
                keys, counts, held = [k], [c], 0
                if len(k) > FLUSH // 2:
                    yield rows()
                    keys, counts = [], []
    if keys:
        yield rows()


def _count_grams(directory, bits: int, bounds_of_files: np.ndarray):
    """Rows (bucket, keys, counts): a task's n-grams by the range of keys that they fall into."""

    def run(batches):
        levels = _levels(directory)
        keys, counts, held = [], [], 0

        def rows():
            k, c = _merged(keys, counts)
            cut = np.concatenate([[0], np.searchsorted(k, bounds_of_files), [len(k)]])
            found = [(b, int(cut[b]), int(cut[b + 1])) for b in np.flatnonzero(np.diff(cut)).tolist()]
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                deltas = [_planes(np.diff(k[i:j], prepend=U(0))) for _, i, j in part]
                times = [_planes(np.minimum(c[i:j], 2**32 - 1).astype(np.uint32)) for _, i, j in part]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in part], pa.int64()), pa.array(deltas, pa.binary()), pa.array(times, pa.binary())], names=["bucket", "keys", "counts"])

        for batch in batches:
            for i, j in slices(batch.column(0), WIDE):
                hashes, bounds = tokens(batch.column(0).slice(i, j - i))
                ranks = _ranks(hashes, bounds, levels, bits)
                context = _context(ranks[-1], bounds, ranks[0], len(levels) + 1)
                k, c = np.unique(_key(context, ranks[0], bits)[context >= 0], return_counts=True)
                keys.append(k)
                counts.append(c.astype(np.int64))
                held += len(k)
                if held > FLUSH:
                    yield from rows()
                    keys, counts, held = [], [], 0
        if held:
            yield from rows()

    return run


FILE = "first long, n long, uri string, low long, high long, s_low double, s_high double, c_low long, c_high long"


def _filed(below, bits: int, root: str, least: int, last: bool):
    """A function that merges a range's counts and writes its file."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_flat(x.as_py(), U), dtype=U) for x in table["keys"]]
        k, c = _merged(keys, [_flat(x.as_py(), np.uint32).astype(np.int64) for x in table["counts"]])
        k, c = (k, c) if least <= 1 else (k[c >= least], c[c >= least])
        names = [x.split()[0] for x in FILE.split(", ")]
        if not len(k):
            return pa.table({n: pa.array([], pa.string() if n == "uri" else pa.float64() if n[0] == "s" else pa.int64()) for n in names})
        context = (k >> U(bits)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        own = context[start]
        total = Level(below).values("count", own)
        spent = np.add.reduceat(c - DISCOUNT, start)
        rest = np.zeros(int(own[-1] - own[0]) + 1, np.uint8)
        rest[own - own[0]] = _quantised(1 - spent / total)
        share = _quantised((c - DISCOUNT) / np.repeat(total, np.diff(np.append(start, len(k)))))
        uri = f"{root}/{table['bucket'][0].as_py()}.bin"
        # the last level is nothing's context
        sharedfiles.save(uri, eliasfano.build(k) | {"p": share, "rest": rest} | ({} if last else {"count": _counts(c)}))
        row = [int((k[:1] ^ SIGN).view(np.int64)[0]), len(k), uri, int(own[0]), int(own[-1]), float(spent[0]), float(spent[-1]), int(total[0]), int(total[-1])]
        return pa.table({n: pa.array([v]) for n, v in zip(names, row, strict=True)})

    return run


def _files(spark: SparkSession, parts, schema: str, run) -> list:
    """Rows that ``run`` makes of each file of a level (column uri and its first rank), a task a file or so."""
    bases = np.concatenate([[0], np.cumsum([n for _, n, _ in parts])]).astype(np.int64).tolist()
    rows = spark.createDataFrame([(uri, base) for (_, _, uri), base in zip(parts, bases, strict=False)], "uri string, base long")

    def each(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield run(base, sharedfiles.load(uri)["count"].astype(np.int64))

    return rows.repartition(max(1, min(len(parts), 4096))).mapInArrow(each, schema).collect()


def _word_cuts(spark: SparkSession, parts, total: int) -> np.ndarray:
    """Ids that cut the words' counts into ``CUTS`` parts of one size; the driver gets a row a file and one a cut."""
    sums = dict(_files(spark, parts, "base long, c long", lambda base, c: pa.RecordBatch.from_arrays([pa.array([base]), pa.array([int(c.sum())])], names=["base", "c"])))
    before, at = {}, 0
    for base in sorted(sums):
        before[base], at = at, at + sums[base]
    step = max(1, total // CUTS)

    def cut(base, c):
        ends = (before[base] + np.cumsum(c)) // step
        return pa.RecordBatch.from_arrays([pa.array(base + np.flatnonzero(np.diff(ends, prepend=before[base] // step)))], names=["id"])

    return np.array(sorted(r["id"] for r in _files(spark, parts, "id long", cut)), np.int64)


def _ranges(spark: SparkSession, parts, cuts: np.ndarray, total: int, bits: int) -> np.ndarray:
    """Keys at which the next level's files begin but the first; as many as its tokens need."""

    def edges(base, c):
        ends = np.cumsum(c) // PER_FILE
        context = np.flatnonzero(np.diff(ends, prepend=0)) + 1
        heavy = np.flatnonzero(c > 2 * PER_FILE)
        inner = [(np.full(n - 1, base + h), cuts[np.linspace(0, len(cuts) - 1, n + 1).astype(np.int64)[1:-1]]) for h in heavy.tolist() if (n := int(min(c[h] // PER_FILE, len(cuts) - 1))) > 1]
        first = np.concatenate([base + context, base + heavy, base + heavy + 1, *(x for x, _ in inner)])
        second = np.concatenate([np.zeros(len(context) + 2 * len(heavy), np.int64), *(y for _, y in inner)])
        return pa.RecordBatch.from_arrays([pa.array(((first.astype(U) << U(bits)) | second.astype(U)).view(np.int64))], names=["k"])

    return np.unique(np.array([r["k"] for r in _files(spark, parts, "k long", edges)], np.int64).view(U))


def _written(rows: DataFrame, root: str, values) -> list[tuple[int, int, str]]:
    """Files of rows (k, ...) in ranges of k; ``values`` makes a file's arrays from its columns."""

    def run(batches):
        part = TaskContext.get().partitionId()
        got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not got:
            return
        t = pa.concat_tables(got)
        keys = t["k"].to_numpy().view(U) ^ SIGN
        uri = f"{root}/{part}.bin"
        sharedfiles.save(uri, eliasfano.build(keys) | values(keys, t))
        yield pa.RecordBatch.from_arrays([pa.array((keys[:1] ^ SIGN).view(np.int64)), pa.array([len(keys)], pa.int64()), pa.array([uri])], names=["first", "n", "uri"])

    made = rows.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(run, "first long, n long, uri string")
    return [(int(np.array([r["first"]], np.int64).view(U)[0] ^ SIGN), r["n"], r["uri"]) for r in made.orderBy("first").collect()]  # one row a file


def _quantised(p: np.ndarray) -> np.ndarray:
    orders = -np.log10(np.maximum(p, 1e-30))
    return np.where(orders < 5.98, np.clip(np.round(orders * STEPS), 0, 191), np.clip(np.round((orders - 6) * 8), 0, 63) + 192).astype(np.uint8)


class Trie:
    """Where the levels lie and what their files' edges leave over, and the totals."""

    def __init__(self, levels, spans, edges, total: int, distinct: int):
        self.levels, self.spans, self.edges, self.total, self.distinct = levels, spans, edges, total, distinct

    @property
    def bits(self) -> int:
        return max(1, int(self.distinct).bit_length())

    def opened(self) -> tuple[list[Level], list[Rests]]:
        levels = _levels(self.levels)
        return levels, [Rests(x, s, e) for x, s, e in zip(levels[1:], self.spans, self.edges, strict=True)]


def train(texts: DataFrame, order: int = 3, least: int = 1) -> Trie:
    """The trie of all texts (column text)."""
    spark = texts.sparkSession
    root = new_path(spark, "trie")
    texts = texts.select("text")
    words = texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    words = materialize(words.select(F.col("h").alias("k"), "c"), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    trie = Trie([_written(words, f"{root}/1", lambda k, t: {"count": _counts(t["c"].to_numpy())})], [], [], total, distinct)
    discard(words)
    bits = trie.bits
    cuts = _word_cuts(spark, trie.levels[0], total)
    for n in range(2, order + 1):
        below = trie.levels[-1]
        if sum(p[1] for p in below).bit_length() + bits > 64:
            raise ValueError(f"{sum(p[1] for p in below)} contexts and {distinct} words do not fit into keys of 64 bits: train with a lower order")
        grams = texts.mapInArrow(_count_grams(list(trie.levels), bits, _ranges(spark, below, cuts, total, bits)), "bucket long, keys binary, counts binary")
        files = grams.groupBy("bucket").applyInArrow(_filed(below, bits, f"{root}/{n}", least, n == order), FILE).collect()  # one row a file
        files.sort(key=lambda r: int(np.int64(r["first"]).view(U) ^ SIGN))
        spent: dict[int, list] = {}
        for r in files:
            for context, s, c in {(r["low"], r["s_low"], r["c_low"]), (r["high"], r["s_high"], r["c_high"])}:
                spent.setdefault(context, [0.0, c])[0] += s
        trie.levels.append([(int(np.int64(r["first"]).view(U) ^ SIGN), r["n"], r["uri"]) for r in files])
        trie.spans.append([(r["low"], r["high"]) for r in files])
        trie.edges.append({k: int(_quantised(np.array([1 - s / c]))[0]) for k, (s, c) in spent.items()})
    return trie


def _counts(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint32) if not len(c) or c.max() < 1 << 32 else c.astype(np.uint64)


def _values(level: Level, found: np.ndarray, back: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Probabilities by row from quantised values of distinct keys; 0 without an entry."""
    hit = found >= 0
    p = np.zeros(len(found))
    p[hit] = POWERS[level.values("p", found[hit])]
    out = np.zeros(len(ok))
    out[ok] = p[back]
    return out


def score(texts: pa.Array, levels: list[Level], rests: list[Rests], total: int, distinct: int, bits: int):
    """(tokens, known tokens, base score, score) of each text."""
    hashes, bounds = tokens(texts)
    found, back, ids = levels[0].looked_up(hashes ^ SIGN, np.ones(len(hashes), bool))
    hit = found >= 0
    c = np.zeros(len(found))
    c[hit] = levels[0].values("count", found[hit])
    c = c[back]
    p = (c + 1) / (total + distinct + 1)
    at = bounds[:-1]
    base = np.add.reduceat(np.log10(p), at)
    ranks, left_over = ids, found
    for n, (level, left) in enumerate(zip(levels[1:], rests, strict=True), 2):
        rest = left.values(left_over)[back]
        if n > 2:  # by row: tokens that were not looked up have no rank
            rest, some = np.zeros(len(ids), np.uint8), rest
            rest[ok] = some
        context = _context(ranks, bounds, ids, n)
        before = np.empty_like(rest)
        before[1:] = rest[:-1]
        before[bounds[:-1]] = rest[bounds[1:] - 1]
        ok = context >= 0
        p[ok] *= POWERS[before[ok]]
        ok &= ids >= 0
        left_over, back, ranks = level.looked_up(_key(context, ids, bits), ok)
        p = p + _values(level, left_over, back, ok)
    return np.diff(bounds), np.add.reduceat((c > 0).astype(np.int64), at), base, np.add.reduceat(np.log10(p), at)


def scored(documents: DataFrame, order: int = 3, least: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); trained on documents not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = documents.select("doc_id", held.alias("held_out"), "text")
    trie = train(rows.where(~F.col("held_out")), order, least)
    total, distinct, bits = trie.total, trie.distinct, trie.bits

    def run(batches):
        opened, left = trie.opened()
        for batch in batches:
            for i, j in slices(batch.column(2), WIDE):
                part = batch.slice(i, j - i)
                n, known, base, model = score(part.column(2), opened, left, total, distinct, bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(np.full(j - i, total, np.int64)), pa.array(base), pa.array(model)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
