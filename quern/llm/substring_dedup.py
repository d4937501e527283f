"""Operator 12: words of passages that occur before are removed, by FM-indexes over shards.

A window is ``width`` consecutive words of a document; it repeats if the same words stand
at a smaller (doc_id, start).

1. Documents are cut into segments: runs of windows whose smallest hash of ``RUN``
   consecutive words, the anchor, is the same (at most ``MOST`` windows a segment).  Equal
   windows have equal anchors.  Segments whose anchor stands at one place in the corpus
   repeat nothing and go no further; of each other segment the first occurrence stands for all.
2. Segments are dealt to shards by their anchor, so all that may agree meets in one;
   shards hold about ``SHARD`` words, so their number grows with the corpus.
3. A shard's segments become a compressed FM-index (``quern.llm.fmindex``).  Its segments
   are streamed through backward search, which gives for each place whether the match
   reaches ``width`` words and where that window begins first.
4. An occurrence of a segment that is not its first is repeated wholly, the first one
   where the search says so.  Words under repeated windows go.

An anchor with more than ``hot`` different segments (a passage in many documents, each
with other words around it) would not fit into a shard: its segments fall into single
windows, whose first places are grouped minima, summed up before they are shuffled.

Words are known by 64-bit hashes; that two of V distinct words, or of as many segments,
share one has a probability below V * V * 2**-64.

Defined results: null and empty texts have no words, texts of fewer than ``width`` lose
none; documents without an id come after all others; rows with one id are one document:
of equal windows in them the smaller start is the earlier, and at equal starts none is;
other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.fmindex import FMIndex
from quern.llm.sized import small
from quern.llm.textkit import _BASE, _INV, U, Words, _power, mix, slices
from quern.scratch import discard, materialize

WIDTH, RUN, MOST = 20, 5, 32
SHARD = 1 << 19
HOT = 1 << 13
LAST = (1 << 63) - 1

CUT = "k long, doc long, anchor long, key long, start int, n int, times int, sha binary"


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``_run`` takes the hash of any run of words."""
    out = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * _power(_BASE, "base", len(hashes))[: len(hashes)], out=out[1:])
    return out


def _run(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _power(_INV, "inv", len(sums))[start] ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


def segments(words: Words, width: int) -> tuple[np.ndarray, ...]:
    """(row, place of the first word, windows, anchor, key, times) of each segment; times: 2 if the anchor stands in it more than once."""
    h, row = words.hash, words.row
    windows = len(h) - width + 1
    if windows <= 0:
        return (*(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, U) for _ in range(2)), np.empty(0, np.int64))
    sums, run = _sums(h), min(RUN, width)
    at = np.arange(len(h) - run + 1)
    runs = least = _run(sums, at, at + run)
    have, want = 1, width - run + 1
    while have < want:  # smallest of twice as many hashes, or of as many as are wanted
        step = min(have, want - have)
        least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
    inside = row[:windows] == row[width - 1 :]
    turn = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:windows] != row[: windows - 1])])
    first = np.maximum.accumulate(np.where(turn, np.arange(windows), 0))
    starts = np.flatnonzero(inside & (turn | ((np.arange(windows) - first) % MOST == 0)))
    ends = np.minimum(np.append(starts[1:], windows), starts + MOST)
    gone = np.concatenate([[0], np.cumsum(~inside)])  # windows over the end of a text, which end a segment
    n = ends - starts - (gone[ends] - gone[starts])
    anchor, last = least[starts], starts + n - 1
    left, right = np.zeros_like(starts), np.zeros_like(starts)
    for k in range(want):
        left = np.where(runs[starts + want - 1 - k] == anchor, want - 1 - k, left)
        right = np.where(runs[last + k] == anchor, k, right)
    times = 1 + (starts + left != last + right)
    return row[starts], starts, n, anchor, _run(sums, starts, starts + n + width - 1), times


def _cut(width: int):
    """Segments of each text, and one row a document with its number of words and their digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                texts = batch.column("text").slice(i, j - i)
                words = Words(texts, lower=False)
                counts = words.counts()
                row, starts, n, anchor, key, times = segments(words, width)
                begin = np.concatenate([[0], np.cumsum(counts)])
                docs = batch.slice(i, j - i)
                digests = [hashlib.sha256(b" ".join(t.encode().split())).digest() if t else hashlib.sha256().digest() for t in texts.to_pylist()]
                yield _batch(docs, np.arange(j - i), None, None, None, counts, None, digests)
                yield _batch(docs, row, anchor, key, starts - begin[row], n, times, None)

    return cut


def _batch(docs: pa.RecordBatch, row: np.ndarray, anchor, key, start, n: np.ndarray, times, sha) -> pa.RecordBatch:
    at, size = pa.array(row), len(row)
    return pa.RecordBatch.from_arrays(
        [
            docs.column("k").take(at), docs.column("doc").take(at),
            pa.nulls(size, pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)), pa.nulls(size, pa.int64()) if key is None else pa.array(key.view(np.int64)),
            pa.nulls(size, pa.int32()) if start is None else pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
            pa.nulls(size, pa.int32()) if times is None else pa.array(times.astype(np.int32)), pa.nulls(size, pa.binary()) if sha is None else pa.array(sha, pa.binary()),
        ],
        names=[c.split()[0] for c in CUT.split(", ")],
    )


SPELLED = "shard int, doc long, start int, anchor long, key long, j int, words binary"


def _spelled(width: int, shards: int):
    """The words' hashes of each segment that stands for its kind; of hot ones a row for each window, its hash as ``words``."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                words = Words(batch.column("text").slice(i, j - i), lower=False)
                begin = np.concatenate([[0], np.cumsum(words.counts())])
                out: dict[str, list] = {c.split()[0]: [] for c in SPELLED.split(", ")}
                sums = _sums(words.hash)
                for r, (doc, held) in enumerate(zip(batch.column("doc").slice(i, j - i).to_pylist(), batch.column("held").slice(i, j - i).to_pylist(), strict=True)):
                    for x in held:
                        a = int(begin[r]) + x["start"]
                        if x["hot"]:
                            starts = np.arange(a, a + x["n"])
                            rows = [(-1, doc, x["start"] + w, x["anchor"], x["key"], w, v) for w, v in enumerate(map(bytes, _run(sums, starts, starts + width).view((np.uint8, 8))))]
                        else:
                            rows = [(x["anchor"] % shards, doc, x["start"], x["anchor"], x["key"], x["n"], words.hash[a : a + x["n"] + width - 1].tobytes())]
                        for values in rows:
                            for column, v in zip(out.values(), values, strict=True):
                                column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=list(out))

    return spell


def repeated(texts: list[np.ndarray], places: np.ndarray, width: int) -> np.ndarray:
    """A mask for each segment: bit j says that its window j begins at a smaller place in another.

    ``texts`` are word hashes, at least ``width`` each; ``places`` holds (doc, start), ascending.
    """
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.unique(np.concatenate(texts), return_inverse=True)[1] + 1
    text = np.zeros(base[-1], np.int64)
    inside = np.ones(len(text), bool)
    inside[base[1:] - 1] = False
    text[inside] = symbols
    index = FMIndex(text, width)
    masks = np.zeros(len(texts), np.int64)
    at = base[:-1] + sizes - width  # the last window of each
    lo, hi = index.search(text[at[:, None] + np.arange(width)])
    which = np.arange(len(texts))
    while len(which):
        found = index.first(lo)
        owner = np.searchsorted(base, found, side="right") - 1
        doc, start = places[owner, 0], places[owner, 1] + found - base[owner]
        offset = at - base[which]
        own_doc, own_start = places[which, 0], places[which, 1] + offset
        earlier = (doc < own_doc) | ((doc == own_doc) & (start < own_start))
        masks[which] |= earlier.astype(np.int64) << offset
        on = offset > 0
        which, at = which[on], at[on] - 1
        lo, hi = index.extended(text[at], *index.shortened(lo[on]))
    return masks


def _searched(width: int):
    """Masks of the segments of each shard; rows come by shard and place."""

    def judge(held: list) -> pa.RecordBatch:
        kept = [x for k, x in enumerate(held) if k == 0 or x[:4] != held[k - 1][:4]]
        doc, start, anchor, key, words = zip(*kept, strict=True)
        masks = repeated([np.frombuffer(w, U) for w in words], np.array([doc, start]).T, width)
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(key, pa.int64()), pa.array(masks)], names=["anchor", "key", "mask"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, *rest in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc", "start", "anchor", "key", "words")), strict=True):
                if shard != now and held:
                    yield judge(held)
                    held = []
                now = shard
                held.append(tuple(rest))
        if held:
            yield judge(held)

    return search


def _kept(width: int):
    """Removed words, and the digest of the others, of documents with repeated windows."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, removed, digests = [], [], []
            for k, text, held in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "held")), strict=True):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.array([x["start"] for x in held])
                masks = np.array([x["mask"] for x in held])
                for j in range(MOST):
                    at = starts[masks >> j & 1 == 1] + j
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                ks.append(k)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([words[x] for x in np.flatnonzero(~gone).tolist()])).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.binary())], names=["k", "n_removed", "kept"])

    return keep


def _with_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents beside what is listed for them; texts are shuffled only if neither lists nor keys can be broadcast."""
    held = small(lists)
    if held is lists:
        keys = lists.select("k")
        few = small(keys)
        docs = docs if few is keys else docs.join(few, "k", "left_semi")
    return docs.join(held, "k")


def substring_dedup(documents: DataFrame, width: int = WIDTH, hot: int = HOT, shard: int = SHARD, figures: dict | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words left when those of repeated windows are removed."""
    docs = documents.select(F.xxhash64("doc_id", "text").alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    cut = materialize(docs.mapInArrow(_cut(width), CUT), "segments", "zstd")
    found = cut.where("anchor is not null").select("k", "doc", "anchor", "key", "start", "n")
    again = cut.where("anchor is not null").groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select("anchor")
    live = materialize(found.join(again, "anchor", "left_semi"), "live", "zstd")
    heads = live.groupBy("anchor", "key").agg(F.min(F.struct("doc", "start", "k", "n")).alias("f"), F.count("*").alias("c"))
    heads = materialize(heads.select("anchor", "key", "f.*", "c"), "heads", "zstd")
    many = heads.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("anchor", F.lit(True).alias("hot"))
    total = heads.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    shards = max(1, -(-total // shard))
    listed = heads.join(many, "anchor", "left").groupBy("k").agg(F.collect_list(F.struct("anchor", "key", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("held"))
    spelled = _with_texts(docs, materialize(listed, "listed", "zstd")).mapInArrow(_spelled(width, shards), SPELLED)
    spelled = materialize(spelled, "spelled", "zstd")
    sharded = spelled.where("shard >= 0").drop("j").repartition("shard").sortWithinPartitions("shard", "doc", "start", "anchor", "key")
    masks = sharded.mapInArrow(_searched(width), "anchor long, key long, mask long")
    single = spelled.where("shard < 0").select("words", F.struct("doc", "start").alias("at"), "anchor", "key", "j")
    earliest = single.groupBy("words").agg(F.min("at").alias("first"))
    bits = single.join(earliest, "words").where("first < at").groupBy("anchor", "key").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    masks = materialize(masks.union(bits), "masks", "zstd")
    verdicts = heads.join(masks, ["anchor", "key"], "left").where("c > 1 or mask <> 0").select("anchor", "key", F.struct("doc", "start").alias("first"), F.coalesce("mask", F.lit(0)).alias("mask"))
    whole = F.expr("shiftleft(1L, n) - 1")
    hits = live.join(verdicts, ["anchor", "key"]).select("k", "start", F.when(F.struct("doc", "start") > F.col("first"), whole).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    hits = materialize(hits.groupBy("k").agg(F.collect_list(F.struct("start", "mask")).alias("held")), "hits", "zstd")
    lost = _with_texts(docs.select("k", "text"), hits).mapInArrow(_kept(width), "k long, n_removed long, kept binary").dropDuplicates(["k"])
    if figures is not None:
        figures |= {"segments": found.count(), "live": live.count(), "kinds": heads.count(), "words": total, "shards": shards, "hot anchors": many.count(), "documents": hits.count()}
    rows = cut.where("anchor is null").select("k", F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), F.col("n").cast("long").alias("n_words"), "sha").join(lost, "k", "left")
    out = rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"))
    out = materialize(out, "deduplicated")
    discard(cut, live, heads, spelled, masks, hits)
    return out
