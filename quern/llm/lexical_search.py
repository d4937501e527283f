"""Operator 13: ranked lexical search by a three-phase uniform threshold (TPUT) over term-partitioned postings.

1. Postings (term, document, occurrences) of the queries' terms are taken from whole
   texts, beside the counts of all documents and terms.  With document frequencies they
   become impacts, which are range-partitioned by term and falling impact; a frequent
   term's list runs over many partitions, and each entry knows its place in its part.
2. Heads: the first ``k`` entries of every list give lower bounds of the documents they
   name; a query's ``k``-th highest bound is t1 (0 if fewer documents are named).  These
   documents' whole scores are looked up; the ``k``-th highest of them is t2.
3. Threshold: of each of a query's m lists all entries of t1 / m or more are fetched (of a
   list that several queries have, down to the lowest of their thresholds).  A document
   that none of them names stays below t1.  Fetched entries are shuffled once, by document
   and whatever the number of queries, and summed there for each; what a document may
   gain in its other lists is below t1 / m each, and who cannot reach t2 is dropped.
4. Look-up: of the documents left the entries below the threshold are added; the exact
   scores are ranked.

Terms are known by 64-bit hashes: that a foreign word has the hash of one of V query terms
has a probability of V * 2**-64 a distinct word.  Queries are dealt to blocks of about
``TERMS`` terms, each with its own postings, so what tasks get of the queries is bounded.

Defined results: null and empty texts, of documents and of queries, have no terms; a query
without terms in any document has no result; equal rows of queries are one, queries with
one id and different texts each have a ranking of their own; repeated documents count and
are listed as often as they stand there; documents without an id come last among equals;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.sized import small
from quern.llm.textkit import ALNUM, U, Words, slices
from quern.scratch import discard, materialize

TERMS = 1 << 19
#: Sums of documents and queries that a task holds at once.
CELLS = 1 << 21
POSTINGS = "t long, row long, doc_id long, tf long, n long"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, item_id, t, c): how often each item has each of its terms."""
    for batch in batches:
        for i, j in slices(batch.column("text")):
            words = Words(batch.column("text").slice(i, j - i), ALNUM)
            order = np.lexsort((words.hash, words.row))
            row, h = words.row[order], words.hash[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
            at = pa.array(row[first] + i)
            counts = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([batch.column("q").take(at), batch.column("item_id").take(at), pa.array(h[first].view(np.int64)), pa.array(counts.astype(np.int64))], names=["q", "item_id", "t", "c"])


class Vocabulary:
    """The terms that are asked for, with a bitmap that most other words do not pass."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.view(U))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms >> U(44)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words are terms, place of each of these)."""
        at = np.flatnonzero(self.maybe[(hashes >> U(44)).astype(np.int64)])
        if not len(self.terms):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[place] == hashes[at]
        return at[same], place[same]


def _posted(terms: np.ndarray):
    """Postings of each text, and a row without a term for the counts of documents and terms."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, docs, total = Vocabulary(terms), 0, 0
        v = max(1, len(terms))
        for batch in batches:
            for i, j in slices(batch.column("text")):
                words = Words(batch.column("text").slice(i, j - i), ALNUM)
                sizes = words.counts()
                docs, total = docs + int((sizes > 0).sum()), total + int(sizes.sum())
                which, place = vocabulary.places(words.hash)
                keys, tf = np.unique(words.row[which] * v + place, return_counts=True)
                row = keys // v
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vocabulary.terms[keys % v].view(np.int64)), batch.column("row").take(at), batch.column("doc_id").take(at).cast(pa.int64()), pa.array(tf.astype(np.int64)), pa.array(sizes[row].astype(np.int64))],
                    names=["t", "row", "doc_id", "tf", "n"],
                )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["t", "row", "doc_id", "tf", "n"])

    return post


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at``: an entry's place in the part of its term's list that lies in this partition."""
    term, seen = None, 0
    for batch in batches:
        t = batch.column("t").to_numpy()
        if not len(t):
            continue
        starts = np.flatnonzero(np.concatenate([[t[0] != term], t[1:] != t[:-1]]))
        at = np.arange(len(t)) + seen
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(t)], strict=False):
            at[a:b] = np.arange(b - a)
        term, seen = t[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])


def impacts(postings: DataFrame) -> DataFrame:
    """(t, s, row, doc_id, at): each posting's score, lists by falling score, as a written table."""
    counted = postings.where("t is null").agg(F.sum("tf"), F.sum("n")).first()
    docs, total = counted[0] or 0, max(counted[1] or 0, 1)
    entries = postings.where("t is not null")
    df = entries.groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2.0 * docs) + 2) / (F.lit(2) * F.col("df") + 1)))
    entries = entries.join(small(df.select("t", weight.alias("w"))), "t")
    scored = entries.selectExpr("t", f"w * ((1000000000L * tf) div (1000 * tf + 12 * (75 + (25 * n * {docs}L) div {total}L))) AS s", "row", "doc_id").where("s > 0")
    order = [F.col("t"), F.col("s").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    scored = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(scored.mapInArrow(_numbered, "t long, s long, row long, doc_id long, at long"), "impacts", "zstd")


def _highest(rows: DataFrame, score: str, k: int) -> DataFrame:
    """(q, least): each query's k-th highest score; queries with fewer rows have none."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col(score).desc()))).where(F.col("r") == k).select("q", F.col(score).alias("least"))


class Asked:
    """The queries' lists by term, with what each query has to reach."""

    def __init__(self, bounds: pa.Table):
        """bounds: q, t, c, m, t1, t2."""
        held = {c: bounds.column(c).to_numpy() for c in ("q", "t", "c", "m", "t1", "t2")}
        order = np.argsort(held["t"], kind="stable")
        self.terms, first = np.unique(held["t"][order], return_index=True)
        self.first = np.append(first, len(order))
        self.queries, at, back = np.unique(held["q"], return_index=True, return_inverse=True)
        self.query, self.count = back[order], held["c"][order]
        self.m, self.t1, self.t2 = (held[c][at] for c in ("m", "t1", "t2"))
        self.gain = np.maximum(self.t1 - 1, 0) // np.maximum(self.m, 1)

    def summed(self, t: np.ndarray, row: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a document's first entry, query, lower bound) of who may still reach t2; a document's entries stand together."""
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        doc = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]).astype(np.int64)]))
        place = np.searchsorted(self.terms, t)
        times = self.first[place + 1] - self.first[place]
        entry = np.repeat(np.arange(len(t)), times)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[place], times)
        size = len(self.queries)
        cell = doc[entry] * size + self.query[at]
        low, seen = np.zeros(len(starts) * size, np.int64), np.bincount(cell, minlength=len(starts) * size)
        np.add.at(low, cell, self.count[at] * s[entry])
        held = np.flatnonzero(seen)
        q = held % size
        held = held[low[held] + (self.m[q] - seen[held]) * self.gain[q] >= self.t2[q]]
        return starts[held // size], held % size, low[held]


def _gathered(asked: Asked):
    """Candidates out of fetched entries, which come by document; as many documents at once as ``CELLS`` allow."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            row = held.column("row").to_numpy()
            whole = int(np.searchsorted(row, row[-1]))  # the last document may go on
            if whole:
                yield held.slice(0, whole)
                held = held.slice(whole)
        if held is not None:
            yield held

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(asked.queries)))
        for block in blocks(batches):
            t, row, s = (block.column(c).to_numpy() for c in ("t", "row", "s"))
            doc_id = block.column("doc_id")
            cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))[::step]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=True):
                first, query, low = asked.summed(t[a:b], row[a:b], s[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(asked.queries[query]), pa.array(row[a + first]), doc_id.take(pa.array(a + first)).combine_chunks(), pa.array(low)], names=["q", "row", "doc_id", "low"])

    return gather


def tput(lists: DataFrame, asked: DataFrame, k: int, figures: dict | None = None) -> DataFrame:
    """(q, rank, doc_id, score) of the ``k`` highest sums of c * s over each query's terms; asked: (q, t, c)."""
    first = Window.partitionBy("t").orderBy(F.col("s").desc(), F.col("doc_id").asc_nulls_last(), "row")
    heads = lists.where(F.col("at") < k).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    present = asked.join(small(lists.where(F.col("at") == 0).select("t").distinct()), "t", "left_semi")
    sizes = present.groupBy("q").agg(F.count("*").alias("m"))
    present = materialize(present.join(sizes, "q"), "lists")
    worth = F.col("c") * F.col("s")
    low = materialize(heads.join(small(present), "t").groupBy("q", "row").agg(F.sum(worth).alias("low")), "heads")
    # the documents in the heads are looked up wholly: their scores are bounds too, and better ones
    known = lists.join(small(low.select("row").distinct()), "row", "left_semi").join(small(present), "t").join(small(low.select("q", "row")), ["q", "row"])
    known = known.groupBy("q", "row").agg(F.sum(worth).alias("low"))
    bounds = present.join(_highest(low, "low", k).withColumnRenamed("least", "t1"), "q", "left").join(_highest(known, "low", k).withColumnRenamed("least", "t2"), "q", "left")
    bounds = materialize(bounds.fillna(0, ["t1", "t2"]), "bounds")
    discard(present)

    # an entry is fetched, for all who ask for its term, if it reaches some query's threshold, or if a head may hold it
    needed = bounds.groupBy("t").agg(F.min(F.ceil(F.col("t1") / (F.col("c") * F.col("m")))).alias("need"))
    listed = lists.join(small(needed), "t")
    fetched = (F.col("s") + 1 >= F.col("need")) | (F.col("at") < k)
    some = listed.where(fetched).select("t", "row", "s", "doc_id")
    table = bounds.select("q", "t", "c", "m", "t1", "t2").toArrow()  # of one block of queries, about TERMS rows
    left = some.repartition("row").sortWithinPartitions("row").mapInArrow(_gathered(Asked(table)), "q long, row long, doc_id long, low long")
    left = materialize(left, "candidates", "zstd")

    rest = listed.where(~fetched).join(small(left.select("row").distinct()), "row", "left_semi").join(small(bounds), "t")
    rest = rest.join(small(left.select("q", "row")), ["q", "row"], "left_semi").select("q", "row", worth.alias("low"), F.lit(None).cast("long").alias("doc_id"))
    exact = left.unionByName(rest).groupBy("q", "row").agg(F.sum("low").alias("score"), F.min("doc_id").alias("doc_id"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    ranked = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "rank", "doc_id", "score")
    if figures is not None:
        figures |= {"entries": lists.count(), "heads": low.count(), "fetched": some.count(), "candidates": left.count(), "looked up": rest.count()}
    ranked = materialize(ranked, "ranked")
    discard(bounds, low, left)
    return ranked


def search(documents: DataFrame, items: DataFrame, k: int = 20, terms: int = TERMS, figures: dict | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, scores above 0, equal ones by doc_id."""
    docs = documents.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    queries = items.select(F.xxhash64("item_id", "text").alias("q"), "item_id", "text").dropDuplicates(["q"])
    kind = items.schema["item_id"].dataType.simpleString()
    asked = materialize(queries.mapInArrow(_asked, f"q long, item_id {kind}, t long, c long"), "asked")
    blocks = max(1, -(-asked.count() // terms))
    found = []
    for b in range(blocks):
        block = asked.where(_block(blocks) == b)
        vocabulary = np.array([r[0] for r in block.select("t").distinct().collect()], np.int64)  # about ``terms`` at most
        postings = materialize(docs.mapInArrow(_posted(vocabulary), POSTINGS), "postings", "zstd")
        lists = impacts(postings)
        discard(postings)
        found.append(tput(lists, block.select("q", "t", "c"), k, figures))
        discard(lists)
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.union(more)
    return ranked.join(small(asked.select("q", "item_id").distinct()), "q").select("item_id", "rank", "doc_id", "score")


def _block(blocks: int) -> Column:
    return F.pmod(F.col("q"), F.lit(blocks))
