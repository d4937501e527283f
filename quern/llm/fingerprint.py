"""Operator 10: document fingerprints by a threshold-scaled sketch.

A sketch keeps every hash of a text's distinct five-word shingles that lies below a
fixed fraction of the hash range; of a text with at most ``WHOLE`` shingles it keeps all.
Sketches of parts merge by union into the sketch of the whole, and since the threshold
is the same for all, shares of common hashes estimate containment and likeness even
between very unequal texts.  Two texts that keep all are compared exactly, all others
by what both keep below the threshold.

A fingerprint is written as ``all:hashes`` or ``some:hashes``: whether every hash is
kept, and the kept hashes (the low 40 bits of the 64-bit ones, ten hex digits each) in
order.  Both follow from the set of hashes alone, so merging fingerprints of parts gives
exactly the fingerprint of the union of their shingles.  Two different shingles share a
hash with a probability of 2**-40; among texts of 1,000 shingles each that touches about
one pair of texts in a million, by one shingle.  Without any hash to compare, likeness
and containment are 1 for two texts without words, else 0.

Each text is held against an edited text (its last third replaced by the beginning
of the next document's) and against the next document, in descending doc_id order;
after the last comes the first.  Documents are dealt out by ranges of doc_id and
sorted within; a range's last document meets the next range's first in a join.

Defined results: null text counts as empty; rows that repeat an id follow in a
fixed order of their compressed texts and null ids come last; a single document is its own next; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.textkit import BLOCK, U, Words, shingles, slices
from quern.scratch import materialize

FRACTION = 8
WHOLE = 256
DIGITS = 10
LIMIT = (1 << 4 * DIGITS) // FRACTION - 1


def _written(kept: np.ndarray, whole: bool) -> str:
    return ("all:" if whole else "some:") + "".join([f"{x:0{DIGITS}x}" for x in kept.tolist()])


def fingerprints(texts: pa.Array, width: int = 5) -> list[str]:
    mask = U((1 << 4 * DIGITS) - 1)
    out = []
    for i, j in slices(texts):
        h, bounds = shingles(Words(texts.slice(i, j - i)), width)
        h &= mask
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            u = np.unique(h[a:b])
            whole = len(u) <= WHOLE
            out.append(_written(u if whole else u[u <= U(LIMIT)], whole))
    return out


def _parts(fingerprint: str) -> tuple[bool, frozenset[str]]:
    """(whether all hashes are kept, the kept ones)."""
    mark, kept = fingerprint.split(":")
    return mark == "all", frozenset(kept[k : k + DIGITS] for k in range(0, len(kept), DIGITS))


def _below(kept: frozenset[str]) -> frozenset[str]:
    """The hashes that a sketch of a longer text would keep too."""
    limit = f"{LIMIT:0{DIGITS}x}"
    return frozenset(x for x in kept if x <= limit)


def _comparable(a: str, b: str) -> tuple[frozenset[str], frozenset[str]]:
    """Hashes of each: all if both keep all, else those below the threshold."""
    (all_a, ka), (all_b, kb) = _parts(a), _parts(b)
    return (ka, kb) if all_a == all_b else (_below(ka), _below(kb))


def likeness(a: str, b: str) -> float:
    """Estimated share of common shingles in all of both."""
    if a == b:
        return 1.0
    ka, kb = _comparable(a, b)
    both = len(ka | kb)
    return len(ka & kb) / both if both else 0.0


def containment(a: str, b: str) -> float:
    """Estimated share of a's shingles that b has."""
    if a == b:
        return 1.0
    ka, kb = _comparable(a, b)
    return len(ka & kb) / len(ka) if ka else 0.0


def merged(a: str, b: str) -> str:
    """The fingerprint of the union of two texts' shingles."""
    (all_a, ka), (all_b, kb) = _parts(a), _parts(b)
    kept = ka | kb
    whole = all_a and all_b and len(kept) <= WHOLE
    return ("all:" if whole else "some:") + "".join(sorted(kept if whole else _below(kept)))


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_next")


def _rows(ids: pa.Array, texts: list[str], prints: list[str], following: list[str], following_prints: list[str]) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed_prints = fingerprints(pa.array(changed, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            pa.array(prints, pa.string()), pa.array(changed_prints, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(prints, changed_prints, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(prints, following_prints, strict=True)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(prints, following_prints, strict=True)], pa.float64()),
        ],
        names=list(FIELDS),
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_next double"
EDGE = "part long, first_text string, first_fingerprint string, last_id long, last_text string, last_fingerprint string"


def _walk(batches):
    """Rows of all documents of a range but its last, and one row with the range's edges."""
    part = TaskContext.get().partitionId()
    first = held = None
    names = [c.split()[0] for c in EDGE.split(", ")]

    def both(rows: pa.RecordBatch | None, edge: dict | None) -> pa.RecordBatch:
        n = rows.num_rows if rows else 1
        empty = {f.name: pa.nulls(n, f.type) for f in _arrow(SCHEMA) + _arrow(EDGE)}
        if rows:
            empty |= {c: rows.column(k) for k, c in enumerate(FIELDS)}
        else:
            empty |= {f.name: pa.array([edge[f.name]], f.type) for f in _arrow(EDGE)}
        return pa.RecordBatch.from_pydict(empty)

    for batch in batches:
        unpack = zstandard.ZstdDecompressor().decompress
        sizes = np.cumsum([zstandard.frame_content_size(z.as_buffer()) for z in batch.column(1)])
        cut = np.flatnonzero(np.diff(sizes // BLOCK)) + 1  # about BLOCK bytes of text at a time
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            chunk = batch.slice(i, j - i)
            texts = [unpack(z).decode() for z in chunk.column(1).to_pylist()]
            prints = fingerprints(pa.array(texts, pa.large_string()))
            ids = chunk.column(0).to_pylist()
            if first is None:
                first = (texts[0], prints[0])
            if held:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            if len(ids) > 1:
                yield both(_rows(pa.array(ids[:-1], pa.int64()), texts[:-1], prints[:-1], texts[1:], prints[1:]), None)
            held = (ids[-1], texts[-1], prints[-1])
    if held:
        yield both(None, dict(zip(names, (part, *first, *held), strict=True)))


def _arrow(schema: str) -> list[pa.Field]:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return [pa.field(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]


def _close(batches):
    for batch in batches:
        get = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        yield _rows(pa.array(get["last_id"], pa.int64()), get["last_text"], get["last_fingerprint"], get["next_text"], get["next_fingerprint"])


def _packed(batches):
    """Texts compressed, so that dealing them out by ranges moves half as much."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column(1)
        for i, j in slices(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([pack((t or "").encode()) for t in texts.slice(i, j - i).to_pylist()], pa.binary())], names=["doc_id", "z"])


def neighbours(documents: DataFrame) -> DataFrame:
    """One row (see ``FIELDS``) per document."""
    rows = documents.select("doc_id", "text").mapInArrow(_packed, "doc_id long, z binary").repartitionByRange(F.col("doc_id").desc_nulls_last())
    rows = rows.sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "z")
    found = materialize(rows.mapInArrow(_walk, f"{SCHEMA}, {EDGE}"), "fingerprints", "zstd")
    edges = found.where("part is not null").select(*(c.split()[0] for c in EDGE.split(", ")))
    # one row of numbers a range
    order = edges.select("part").withColumn("k", F.row_number().over(Window.orderBy("part")))
    order = order.crossJoin(F.broadcast(order.agg(F.max("k").alias("n"))))
    here = edges.join(order, "part").select("k", "n", "last_id", "last_text", "last_fingerprint")
    there = edges.join(order, "part").select(F.col("k").alias("then"), F.col("first_text").alias("next_text"), F.col("first_fingerprint").alias("next_fingerprint"))
    pairs = here.join(there, F.col("then") == F.when(F.col("k") == F.col("n"), 1).otherwise(F.col("k") + 1))
    last = pairs.select("last_id", "last_text", "last_fingerprint", "next_text", "next_fingerprint").mapInArrow(_close, SCHEMA)
    return found.where("part is null").select(*FIELDS).union(last)
