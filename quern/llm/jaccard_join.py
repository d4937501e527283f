"""Operator 1: n-gram Jaccard self-join with count-vector trees.

A document is the set of its distinct ``width``-word shingle hashes.  Hashes are
dealt into ``GROUPS`` groups and a set becomes the point of its group counts.
For two sets the sum of coordinate minima bounds their overlap from above, for a
set and a tree page the minima with the page's upper corner do; what the bound
cannot rule out is verified on the sets themselves.

One tree over all documents cannot be spread over machines, and hashed counts of sets of
one size lie so close together that most of its pages would be visited, so sets are first
routed by a key that loses no link: sets with a similarity of t share one of the first
``n - ceil(t n) + 1`` hashes of either in any fixed order.  Each such hash is a bucket, a
tree stands over each bucket (a bucket of up to ``LEAF`` sets is one page), and every
pair that is verified comes out of a tree, by its bound.  The order is that of the
hashes, but those that many texts share (in a fixed number of slots, counted by every
task over all its documents) come last, so that a common passage does not bring
unrelated texts together.  The order bears on cost only, never on the result.

1. Equal sets become one set (the smallest doc_id speaks for it).
2. Covers: in each bucket the tree is searched for one set after another, but only for
   such as no earlier search returned, so a group of near copies gives one pair a member
   and not one for each two.  Pairs are verified on the sets, after a bound by the parities
   of ``FINE`` groups' counts.  Verified links give first components; buckets that still
   hold several components are covered once more in another order.
3. Full searches: buckets that hold several components even then are searched for every
   set.  A set brings the smallest keys of its open buckets and how many it has, so the
   tree's task counts what two prefixes share: a pair that shares too little is ruled out
   there, and one that does not is given by its first shared bucket alone.  Pairs of
   different components that were not verified before are verified.  Pairs inside a
   component are never needed, so no link between components is lost.

Buckets of common hashes are dealt to a third as many parts as there are shuffle
partitions for the covers, by set (so that a group of copies falls into the same parts in
all its buckets), in each round another way; so no bucket has to fit in one task.  Which
sets meet there bears on cost only, since step 3 takes up what is left.  Open buckets beyond ``BLOCK`` sets are
dealt into pairs of blocks, each one task's work.  Sets and shingles are known by 64-bit
hashes: that any two of a billion sets share one has a probability of 3 %, and that two
shingles of one pair of texts of 1,000 words do, of 1e-13.

Defined results: null or empty text has an empty set, links with nothing and is
its own component; repeated rows and equal texts share a component; documents
without an id link like others (a component of none but such has a null id); other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.components import stars
from quern.llm.sized import LIMIT, small
from quern.scratch import discard, materialize

GROUPS = 64
BLOCK = 4096
LEAF = 32
#: A count that may stand for more: two of them bound nothing.
FULL = 255
NAMES = ["a", "b", "na", "nb"]
POINT = ["doc_id", "text_id", "n", "sid", "point", "slot", "times"]
POINTS = "doc_id long, text_id long, n long, sid long, point binary, slot int, times int"
#: Slots of the hash range in which a task counts sets, how many make a slot common, and sets a task remembers.
SLOT_BITS, COMMON, REMEMBERED = 22, 12, 500_000
SLOTS = 1 << SLOT_BITS
#: Rounds of covers before full searches.
COVERS = 2
#: Rows of whole buckets that are covered side by side.
TOGETHER = 40_000
#: Keys of open buckets that a set brings to a full search, and pairs whose keys are compared at once.
KEYS, ABREAST = 32, 8_192
#: Groups of the finer bound that a pair has to pass before its sets are compared whole.
FINE = 4_096


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for i, j in textkit.slices(column):
        h, bounds = textkit.shingles(textkit.Words(column.slice(i, j - i)), width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(h[a:b])


def _sid(u: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(u.tobytes())).astype(np.int64))


def _points(width: int):
    """A row (doc_id, text_id, n, sid, point) per document and, at a task's end, a row (slot, times) per hash slot that is common in it."""

    def run(batches):
        times, seen = np.zeros(SLOTS, np.uint32), set()
        for batch in batches:
            ns, sids, points = [], [], []
            for u in _sets(batch.column(1), width):
                ns.append(len(u))
                sid = _sid(u) if len(u) else None
                sids.append(sid)
                counts = np.bincount((u & textkit.U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
                points.append(np.minimum(counts, FULL).astype(np.uint8).tobytes())
                if sid not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(sid)
                    times[_slots(u)] += 1
            none = pa.nulls(len(ns), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()), pa.array(points, pa.binary()), none, none], names=POINT)
        slots = np.flatnonzero(times >= COMMON)
        none = pa.nulls(len(slots), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(slots), pa.binary()), pa.array(slots, pa.int32()), pa.array(times[slots].astype(np.int32))], names=POINT)

    return run


def _slots(u: np.ndarray) -> np.ndarray:
    return (u >> textkit.U(64 - SLOT_BITS)).astype(np.int64)


def _prefixes(width: int, num: int, den: int, common: np.ndarray):
    """Rows (key, sid, n, hot): the first hashes of each set, once per set and task; common (hot) ones come last in the order."""

    def run(batches):
        last = np.unpackbits(common).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            column = batch.column(0)
            for i, j in textkit.slices(column):
                keys, sids, ns, hot = [], [], [], []
                for u in _sets(column.slice(i, j - i), width):
                    if not len(u) or (s := _sid(u)) in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(s)
                    keep = len(u) - (num * len(u) + den - 1) // den + 1
                    late = last[_slots(u)]
                    keys.append(np.concatenate([u[~late], u[late]])[:keep])
                    hot.append(np.arange(keep) >= len(u) - late.sum())
                    sids.append(np.full(keep, s, np.int64))
                    ns.append(np.full(keep, len(u), np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(hot))], names=["key", "sid", "n", "hot"])

    return run


def _odd(u: np.ndarray) -> np.ndarray:
    """A bit for each of ``FINE`` groups of hashes: whether the set has an odd number of them.  In as many bits as two sets differ here, at least so many hashes are in one of the two alone."""
    counts = np.bincount((u >> textkit.U(8) & textkit.U(FINE - 1)).astype(np.int64), minlength=FINE)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _full(width: int):
    """Rows (sid, n, odd, hashes), once per set and task as long as it remembers."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            column = batch.column(0)
            for i, j in textkit.slices(column):
                sets = {s: u for u in _sets(column.slice(i, j - i), width) if (s := _sid(u)) not in seen}
                if len(seen) < REMEMBERED:
                    seen.update(sets)
                held = list(sets.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([len(u) for u in held], pa.int64()), _lists([_odd(u) for u in held]), _lists(held)], names=["sid", "n", "odd", "hashes"])

    return run


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima: at least the overlap."""
    least = np.minimum(a, b)
    return least.sum(axis=-1, dtype=np.int64) + (least == FULL).any(axis=-1) * (1 << 50)


class CountTree:
    """An R-tree over count vectors: pages of LEAF entries, each with its corners."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels = []
        upper, low, high = self.points, self.sizes, self.sizes
        while len(upper) > 1:
            cut = np.arange(0, len(upper), LEAF)
            upper, low, high = np.maximum.reduceat(upper, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((upper, low, high))

    def search(self, size: int, point: np.ndarray, num: int, den: int) -> np.ndarray:
        """Entries whose bound allows num/den similarity with the query."""
        self.visited = 0
        # overlap / (size + n - overlap) >= num / den for the page's smallest n
        pages = np.arange(len(self.levels[-1][0])) if self.levels else np.empty(0, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[depth]
            self.visited += len(pages)
            fits = (high[pages] * den >= size * num) & (low[pages] * num <= size * den)
            pages = pages[fits]
            bound = _bound(upper[pages], point)
            pages = pages[bound * (num + den) >= (size + low[pages]) * num]
            width = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
            pages = (pages[:, None] * LEAF + np.arange(LEAF)).ravel()
            pages = pages[pages < width]
        if not self.levels:
            pages = np.arange(len(self.sizes))
        self.tested = len(pages)
        bound = _bound(self.points[pages], point)
        pages = pages[bound * (num + den) >= (size + self.sizes[pages]) * num]
        return self.order[pages]


def _page_pairs(unit, sizes, points, num: int, den: int):
    """Places of the pairs inside runs of equal ``unit`` (each a page) that the bound allows, and points looked at: a step compares every row with the one so many places on."""
    found, tested = [], 0
    for step in range(1, len(unit)):
        a = np.flatnonzero(unit[step:] == unit[:-step])
        if not len(a):
            break
        tested += len(a)
        a = a[_bound(points[a], points[a + step]) * (num + den) >= (sizes[a] + sizes[a + step]) * num]
        found.append((a, a + step))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)]), tested


def _tree_pairs(sizes, points, num: int, den: int):
    """The same of one bucket by its tree (each pair once), pages and points looked at."""
    tree, found, pages, tested = CountTree(sizes, points), [], 0, 0
    for i in range(len(sizes)):
        hit = tree.search(int(sizes[i]), points[i], num, den)
        found.append(hit[hit > i])
        pages, tested = pages + tree.visited, tested + tree.tested
    return np.repeat(np.arange(len(sizes)), [len(x) for x in found]), np.concatenate(found), pages, tested


def _rows_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of one length, and which places hold a value."""
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.arange(max(1, n.max(initial=0))) < n[:, None]
    rows = np.zeros(held.shape, np.int64)
    rows[held] = column.flatten().to_numpy()
    return rows, held


def _shared(key, a, b, sizes, many, rows, held, last, num: int, den: int):
    """Places of the pairs that this bucket has to give, and the most keys that they share.

    ``rows``: the smallest keys of each set's open buckets, ascending; ``many``: how many it has; ``last``: up to which key
    they are all there.  Up to the smaller of two sets' last keys all that both hold is seen, beyond it they share at most what the one with fewer has left.  Of one of
    the two all prefix hashes are counted, and no more than the rest of it can be shared besides.  A pair is given by the
    first bucket that both are seen in; by each, if they are seen in none.
    """
    rest = np.maximum(-(-sizes[a] * num // den), -(-sizes[b] * num // den)) - 1
    need = -(-(sizes[a] + sizes[b]) * num // (num + den)) - rest
    at = np.flatnonzero(np.minimum(many[a], many[b]) >= need)
    keep, shared = [], []
    for k in range(0, len(at), ABREAST):
        i = at[k : k + ABREAST]
        x, y = a[i], b[i]
        both = ((rows[x][:, :, None] == rows[y][:, None, :]) & held[x][:, :, None] & held[y][:, None, :]).any(axis=2)
        seen = both.sum(axis=1)
        limit = np.minimum(last[x], last[y])[:, None]
        unseen = [many[z] - ((rows[z] <= limit) & held[z]).sum(axis=1) for z in (x, y)]
        c = seen + np.minimum(*unseen)
        fits = (c >= need[i]) & ((seen == 0) | (rows[x, both.argmax(axis=1)] == key[x]))
        keep.append(i[fits])
        shared.append(c[fits])
    none = np.empty(0, np.int64)
    return np.concatenate([*keep, none]), np.concatenate([*shared, none])


def _units(batches, columns: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole units (runs of equal ``columns``), at least ``least`` at a time, and where the units start."""
    held: list[pa.Table] = []
    rows = 0

    def cut(t: pa.Table) -> np.ndarray:
        unit = np.stack([t[c].to_numpy() for c in columns])
        return np.concatenate([[0], np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= least:
            t = pa.concat_tables(held).combine_chunks()
            starts = cut(t)
            if len(starts) > 1:  # the last unit may go on
                yield t.slice(0, int(starts[-1])), starts[:-1]
                t = t.slice(int(starts[-1]))
            held, rows = [t], 0
    if held and sum(t.num_rows for t in held):
        t = pa.concat_tables(held).combine_chunks()
        yield t, cut(t)


def _found(pairs: list[tuple], pages: int, tested: int, names: list[str] = NAMES) -> pa.RecordBatch:
    """Pairs, and a row without any that holds how many pages and points were looked at."""
    columns = [np.concatenate([p[k] for p in pairs] or [np.empty(0, np.int64)]) for k in range(len(names))]
    none = pa.nulls(1, pa.int64())
    first = [pa.concat_arrays([pa.array(c), none]) for c in columns[:2]]
    rest = [pa.array(np.append(c, x)) for c, x in zip(columns[2:], (pages, tested, 0)[: len(names) - 2], strict=True)]
    return pa.RecordBatch.from_arrays([*first, *rest], names=names)


def _pairs(a, b, sids, sizes):
    low = sids[a] < sids[b]
    x, y = np.where(low, a, b), np.where(low, b, a)
    return sids[x], sids[y], sizes[x], sizes[y]


def _covers(num: int, den: int):
    """Rows (key, salt, sid, n, comp, point) of whole buckets, likeliest first: pairs of a set and those its search returns."""

    def side_by_side(unit, sids, sizes, comps, points, out):
        """Buckets of one page: a round searches each for its first set that none has returned."""
        left, tested = np.arange(len(sids)), 0
        while len(left):
            head = np.concatenate([[True], unit[left][1:] != unit[left][:-1]])
            first = left[np.flatnonzero(head)][np.cumsum(head) - 1]
            bound = _bound(points[left], points[first])
            hit = (bound * (num + den) >= (sizes[left] + sizes[first]) * num) & ~head
            tested += int((~head).sum())
            a, b = left[hit], first[hit]
            other = comps[a] != comps[b]
            out.append(_pairs(a[other], b[other], sids, sizes))
            left = left[~hit & ~head]
        return tested

    def by_tree(rows, sids, sizes, comps, points, out):
        tree = CountTree(sizes[rows], points[rows])
        free, pages, tested = np.ones(len(rows), bool), 0, 0
        for i in range(len(rows)):
            if free[i]:
                found = tree.search(int(sizes[rows[i]]), points[rows[i]], num, den)
                pages, tested = pages + tree.visited, tested + tree.tested
                found = found[free[found] & (found != i)]
                free[found] = free[i] = False
                b = rows[found][comps[rows[found]] != comps[rows[i]]]
                out.append(_pairs(np.full(len(b), rows[i]), b, sids, sizes))
        return pages, tested

    def run(batches):
        for t, starts in _units(batches, ["key", "salt"], TOGETHER):
            sids, sizes, comps = (t[c].to_numpy() for c in ("sid", "n", "comp"))
            points = np.frombuffer(b"".join(t["point"].to_pylist()), np.uint8).reshape(-1, GROUPS)
            lengths = np.diff(np.append(starts, t.num_rows))
            unit = np.repeat(np.arange(len(starts)), lengths)
            small = np.flatnonzero((lengths <= LEAF)[unit])
            out: list[tuple] = []
            tested, pages = side_by_side(unit[small], sids[small], sizes[small], comps[small], points[small], out), int((lengths <= LEAF).sum())
            for k in np.flatnonzero(lengths > LEAF).tolist():
                more = by_tree(np.arange(starts[k], starts[k] + lengths[k]), sids, sizes, comps, points, out)
                pages, tested = pages + more[0], tested + more[1]
            yield _found(out, pages, tested)

    return run


def _trees(num: int, den: int):
    """Rows sorted by (key, i, j): one tree for each run of equal units, searched for every set; those of one page side by side."""

    def run(batches):
        for t, starts in _units(batches, ["key", "i", "j"], 1):
            key, sids, sizes, comps, side, many = (t[c].to_numpy() for c in ("key", "sid", "n", "comp", "side", "many"))
            points = np.frombuffer(b"".join(t["point"].to_pylist()), np.uint8).reshape(-1, GROUPS)
            rows, held = _rows_of(t["least"].combine_chunks())
            stored = held.sum(axis=1)
            last = np.where(many > stored, rows[np.arange(len(rows)), stored - 1], np.iinfo(np.int64).max)
            out = []

            def give(a, b):
                keep = (comps[a] != comps[b]) & ((side[a] != side[b]) | (side[a] < 0))
                a, b = a[keep], b[keep]
                low = sids[a] < sids[b]
                a, b = np.where(low, a, b), np.where(low, b, a)
                at, c = _shared(key, a, b, sizes, many, rows, held, last, num, den)
                a, b = a[at], b[at]
                out.append((sids[a], sids[b], sizes[a], sizes[b], c))

            lengths = np.diff(np.append(starts, t.num_rows))
            unit = np.repeat(np.arange(len(starts)), lengths)
            small = np.flatnonzero((lengths <= LEAF)[unit])
            a, b, tested = _page_pairs(unit[small], sizes[small], points[small], num, den)
            give(small[a], small[b])
            pages = int((lengths <= LEAF).sum())
            for k in np.flatnonzero(lengths > LEAF).tolist():
                s, e = starts[k], starts[k] + lengths[k]
                a, b, p, n = _tree_pairs(sizes[s:e], points[s:e], num, den)
                give(s + a, s + b)
                pages, tested = pages + p, tested + n
            yield _found(out, pages, tested, [*NAMES, "c"])

    return run


def _named(doc_id: Column) -> Column:
    """The id, all null ids as one."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def _verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity: what a finer bound cannot rule out is compared whole.

    Of the texts only the speakers' are read on, without a shuffle as long as these are few enough for a broadcast.
    """
    ends = lambda p: p.select(F.col("a").alias("sid")).union(p.select("b"))
    speakers = materialize(heads.join(ends(pairs).distinct(), "sid", "left_semi").select("speaker"), "speakers")
    few = small(speakers)
    sets = docs.join(few, _named(docs["doc_id"]) == few["speaker"], "left_semi").select("text").mapInArrow(_full(width), "sid long, n long, odd array<long>, hashes array<long>")
    sets = materialize(sets, "sets")

    def both(p: DataFrame, held: DataFrame, column: str) -> DataFrame:
        held = held.dropDuplicates(["sid"])
        for side in ("a", "b"):
            p = p.join(held.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col(column).alias(f"h{side}")), side)
        return p

    apart = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = both(pairs, sets.select("sid", "n", "odd"), "odd").where(apart * (num + den) <= (F.col("na") + F.col("nb")) * (den - num))
    near = materialize(near.select("a", "b"), "near")
    same = F.size(F.array_intersect("ha", "hb"))
    # so few that they may repeat, or distinct ones
    few = F.broadcast(ends(near)) if near.count() * 32 <= LIMIT else small(ends(near).distinct())
    held = both(near, sets.join(few, "sid", "left_semi").select("sid", "n", "hashes"), "hashes")
    held = materialize(held.where(F.lit(den) * same >= F.lit(num) * (F.col("na") + F.col("nb") - same)).select("a", "b"), "links")
    discard(speakers, sets, near)
    return held


def _common(points: DataFrame) -> np.ndarray:
    """A bit for each slot, of fixed size: whether some task found it common.  The driver gets a row for 64 slots."""
    words = points.where("slot is not null").groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("b"))
    mask = np.zeros(SLOTS >> 6, np.int64)
    for r in words.collect():  # at most SLOTS / 64 rows
        mask[r["w"]] = r["b"]
    return np.packbits(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` (with sid) and the component of each; ``roots`` has a row (a, b) for every set that is not its component's root."""
    if roots is None:
        return rows.withColumn("comp", F.col("sid"))
    return rows.join(roots.select(F.col("a").alias("sid"), F.col("b").alias("root")), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")


def _joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Roots after the links are added; what they replace goes."""
    found = stars(links, roots)
    discard(links, *([] if roots is None else [roots]))
    return found


def _open(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component; buckets are summed up on either side of the shuffle."""
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return rows.join(several, "key", "left_semi")


def _summed(found: DataFrame, figures: dict | None, name: str, c: Column) -> DataFrame:
    """Pairs (a, b, na, nb, c), each once; what the search looked at goes to ``figures``."""
    if figures is not None:
        found = materialize(found, "found")
        seen = found.where("a is null").agg(F.sum("na"), F.sum("nb")).first()
        figures[name] = {"pages": seen[0] or 0, "points": seen[1] or 0, "survivors": found.where("a is not null").count()}
    return found.where("a is not null").groupBy(*NAMES).agg(c.alias("c"))


def jaccard_components(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100, figures: dict | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, text_id, component): similarity num/den or more links two documents.

    component is one of the component's set_ids, null without words; text_id is a hash of the text.

    ``figures`` is filled with pages and points looked at, pairs that survive the bound, and those verified, by step.
    """
    docs = documents.select("doc_id", "text")
    points = materialize(docs.withColumn("text_id", F.xxhash64("text")).mapInArrow(_points(width), POINTS), "points")
    some = points.where("n > 0")
    heads = some.groupBy("sid").agg(F.min("doc_id").alias("doc"), F.max(_named(F.col("doc_id"))).alias("speaker"), F.first("n").alias("n"), F.first("point").alias("point"))

    # a hot key's rows are dealt to several parts, and stay without a look at the others
    salts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3)
    salt = lambda turn: F.when(F.col("hot"), F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(salts))).otherwise(0).cast("int")
    rows = docs.select("text").mapInArrow(_prefixes(width, num, den, _common(points)), "key long, sid long, n long, hot boolean")
    rows = rows.withColumn("salt", salt(0)).repartition("key", "salt")
    # by size the nearest other set is next to a row (of rows that repeat a set, to the first or the last)
    part = Window.partitionBy("key", "salt").orderBy("n", "sid")
    fits = lambda x: F.coalesce((x["sid"] != F.col("sid")) & (F.least(x["n"], "n") * den >= F.greatest(x["n"], "n") * num), F.lit(False))
    beside = F.struct("sid", "n")
    shared = rows.withColumns({"lo": F.lag(beside).over(part), "hi": F.lead(beside).over(part)}).where(F.col("hot") | fits(F.col("lo")) | fits(F.col("hi")))
    shared = materialize(shared.dropDuplicates(["key", "salt", "sid"]).select("key", "hot", "sid", "n"), "buckets", "zstd")

    # likeliest first: of a group of copies the one with the fewest hashes of its own, then another order
    known = heads.select("sid", "point").join(shared.groupBy("sid").agg(F.count("*").alias("times")), "sid")
    roots, tried, now = None, None, _labelled(shared, None)
    for turn in range(COVERS):
        order = -F.col("times") / F.col("n") if turn == 0 else F.xxhash64("sid", F.lit(turn))
        units = now.join(known, "sid").select("key", salt(turn).alias("salt"), "sid", "n", "comp", "point", order.alias("o"))
        units = units.repartition("key", "salt").sortWithinPartitions("key", "salt", "o", "sid")
        found = units.drop("o").mapInArrow(_covers(num, den), "a long, b long, na long, nb long")
        pairs = _summed(found, figures, f"cover {turn + 1}", F.count("*"))
        # what covers leave out, full searches find: here a quarter of the prefix must agree
        pairs = pairs.where(F.col("c") * 4 * den >= F.least("na", "nb") * (den - num)).select("a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        held = _verified(pairs, docs, heads, width, num, den)
        tried = pairs if tried is None else tried.union(pairs)
        if figures is not None:
            figures[f"cover {turn + 1}"] |= {"verified": pairs.count(), "links": held.count()}
        if held.isEmpty():
            break
        roots = _joined(held, roots)
        before, now = now, materialize(_open(_labelled(shared, roots)), "open")
        discard(before)

    sizes = now.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "blocks")
    # a set's own keys, no more than its prefix; of long ones the smallest go along
    own = now.groupBy("sid").agg(F.count("*").alias("many"), F.slice(F.array_sort(F.collect_list("key")), 1, KEYS).alias("least"))
    ranked = now.join(sizes, "key").join(known.drop("times"), "sid").join(own, "sid").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(9)), F.col("blocks")))
    whole = ranked.where("blocks = 1").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "sid", "n", "comp", F.lit(-1).alias("side"), "point", "many", "least")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    parts = ranked.where("blocks > 1").withColumn("o", other)
    parts = parts.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "sid", "n", "comp", F.when(F.col("block") == F.col("o"), -1).otherwise(F.when(F.col("block") < F.col("o"), 0).otherwise(1)).alias("side"), "point", "many", "least")
    units = whole.union(parts).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = _summed(units.mapInArrow(_trees(num, den), "a long, b long, na long, nb long, c long"), figures, "full", F.max("c")).select("a", "b", "c")
    more = materialize(more if tried is None else more.join(tried, ["a", "b"], "left_anti"), "pairs")
    # of two components' pairs first the likeliest; the others only if that has not joined the two
    for last in (False, True):
        if more.isEmpty():
            break
        left = _labelled(more.withColumnRenamed("a", "sid"), roots).withColumnsRenamed({"sid": "a", "comp": "ca", "b": "sid"})
        left = _labelled(left, roots).withColumnsRenamed({"sid": "b", "comp": "cb"}).where("ca <> cb")
        if not last:
            left = left.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max(F.struct("c", "a", "b")).alias("p")).select("p.a", "p.b")
        left = materialize(left.select("a", "b"), "pairs")
        held = _verified(left, docs, heads, width, num, den)
        if figures is not None:
            figures["full" if not last else "full, rest"] = figures.get("full", {}) | {"verified": left.count(), "links": held.count()} if not last else {"verified": left.count(), "links": held.count()}
        discard(left)
        if not held.isEmpty():
            roots = _joined(held, roots)

    named = _labelled(heads.select("sid", "doc"), roots)
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = named.select("sid", "comp").join(least, "comp").select("sid", "comp", "component_id")
    out = points.where("slot is null").select("doc_id", "text_id", "n", "sid").join(named, "sid", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("sid").alias("set_id"), "text_id", F.col("comp").alias("component")), "components")
    discard(points, shared, more, now, *([] if roots is None else [roots]))
    return out


def keep_one(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, with its columns: the smallest doc_id, of repeated ids one text by its hash.

    Documents without an id come last; of rows that agree in id and text one stays; documents without words link with
    nothing and all stay.
    """
    found = jaccard_components(documents, width, num, den).where("component is not null")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("first_id"), F.col("f.text_id").alias("first_text")).distinct()
    rows = documents.select(F.struct(*documents.columns).alias("row")).withColumns({"id": F.col("row.doc_id"), "h": F.xxhash64("row.text")})
    worded = F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = rows.where(worded).join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_text")), "left_semi").dropDuplicates(["id", "h"])
    return kept.union(rows.where(~worded)).select("row.*")
