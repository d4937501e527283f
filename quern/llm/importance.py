"""Operator 7: quality classifier by importance resampling.

Two generative models over hashed n-grams are fitted: one for target text (documents
labelled good and not toxic), one for the raw corpus (all documents, labelled or not).
Both give each n-gram the smoothed share of documents that have it; the raw counts are
scaled to the target's size first, so that smoothing bears on both alike.  A
document's log weight is the sum of the log ratios of its n-grams: how much likelier
the target produces it than the corpus does.  Gumbel noise is added to the weight over
the temperature and the k largest keys are kept, which draws k documents without
replacement, in proportion to their weights at temperature 1.

The models have two independent halves: content (words and word pairs) and form (token
shapes and pairs of them with their share of the text).  A document's weight is the
smaller of the two log ratios, each counted from a threshold below which labelled
documents that the models have not seen are mostly unwanted.  A bin whose counts in the
two models differ by less than a stated number of standard errors has the same
probability in both, so the noise of a hundred thousand rare pairs cannot drown the few
n-grams that matter.

k is a stated share of the documents, or by default the number of those whose weight
reaches the threshold: the share that the labelled documents let expect.

The target model and the thresholds take a bounded sample: at most ``sample`` labelled
documents, the first by a hash of doc_id (of these a third is held back for the
thresholds).  Raw counts and scores cover every document and its whole text.

Defined results: null or empty text has no evidence, a log weight of 0 less the (never
positive) threshold, and so is kept unless ``k`` or ``share`` says otherwise; equal
texts have equal weights; keys that tie with the k-th are kept; without labels of both
kinds everything is kept; rows that repeat an id count each; other columns pass through,
whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textkit import MARKS, U, Words, mix, slices, views
from quern.scratch import discard, materialize

WORD_BITS, FORM_BITS = 18, 16
#: Bins: words, word pairs, forms.
PAIRS, FORMS, BINS = 1 << WORD_BITS, 2 << WORD_BITS, (2 << WORD_BITS) + (1 << FORM_BITS)
#: Added to the counts of both models.
SMOOTHING = 0.5
_PAIR = U(0xC2B2AE3D27D4EB4F)

#: Digit, upper case, lower case, other letters; marks are 0.
_CLASS = np.zeros(256, np.uint64)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 1, 2, 3, 4


def content(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of the words and word pairs of each text, each once."""
    h, r = words.hash, words.row
    same = r[:-1] == r[1:]
    low = U(PAIRS - 1)
    pairs = (mix(h[:-1] * _PAIR + h[1:])[same] & low) | U(PAIRS)
    return _once(np.concatenate([h & low, pairs]), np.concatenate([r, r[:-1][same]]))


def form(words: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of token shapes and pairs of them, each with the power of two of its share."""
    h, r = words.hash, words.row
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = _CLASS[raw[words.start]]
    second = np.where(words.end - words.start > 1, _CLASS[raw[np.minimum(words.start + 1, len(raw) - 1)]], U(7))
    second[first == 4] = U(5)
    same = r[:-1] == r[1:]
    again = np.zeros(len(h), U)
    again[1:] = (h[1:] == h[:-1]) & same
    shape = mix(np.where(first == 0, h, first * U(64) + second * U(8) + again + U(1)))
    f = np.concatenate([shape, mix(shape[:-1] * _PAIR + shape[1:])[same]])
    rows = np.concatenate([r, r[:-1][same]])
    order = np.lexsort((f, rows))
    f, rows = f[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (rows[1:] != rows[:-1])]))
    times = np.diff(np.append(at, len(f)))
    f, rows = f[at], rows[at]
    share = np.maximum(np.floor(np.log2(times / words.counts()[rows])), -7).astype(np.int64) + 8
    return _once((mix(f + share.astype(U) * _PAIR) & U((1 << FORM_BITS) - 1)) + U(FORMS), rows)


def _once(bins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort((rows.astype(np.int64) << 20) | bins.astype(np.int64))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both & ((1 << 20) - 1), both >> 20


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of each text's n-grams, each once."""
    words = Words(texts, MARKS)
    parts = [content(words), form(words, views(texts)[0])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass(frozen=True)
class Model:
    """Log ratios of the bins that differ, and the thresholds of form and content."""

    bins: np.ndarray
    ratios: np.ndarray
    form: float = 0.0
    content: float = 0.0

    def dense(self) -> np.ndarray:
        out = np.zeros(BINS)
        out[self.bins] = self.ratios
        return out


def log_ratios(texts: pa.Array, dense: np.ndarray) -> np.ndarray:
    """Two columns: log ratio of form, of content."""
    parts = [np.empty((0, 2))]
    for i, j in slices(texts):
        bins, rows = features(texts.slice(i, j - i))
        at = bins >= FORMS
        parts.append(np.stack([np.bincount(rows[k], dense[bins[k]], j - i) for k in (at, ~at)], axis=1))
    return np.concatenate(parts)


def gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    h = np.array([xxhash.xxh3_64_intdigest(str(x).encode(), seed) for x in ids.to_pylist()], np.uint64)
    u = ((h >> U(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def weights(texts: pa.Array, model: Model, dense: np.ndarray) -> np.ndarray:
    return (log_ratios(texts, dense) - [model.form, model.content]).min(axis=1)


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """Between two scores where the fewest labelled rows fall on the wrong side; never above 0."""
    if not len(score) or good.all():
        return float(min(score.min(initial=0.0), 0.0) - 1)
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    wrong = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((~g)[::-1])[::-1], [0]])
    edge = np.concatenate([[True], s[1:] > s[:-1], [True]])
    k = int(np.where(edge, wrong, len(s) + 1).argmin())
    cut = s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2
    return float(min(cut, 0.0))


def _counted(batches):
    """(bin, raw, target) of a task's documents; bin -1 holds their numbers."""
    raw, target = np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64)
    for batch in batches:
        wanted = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
        for i, j in slices(batch.column(1)):
            bins, rows = features(batch.column(1).slice(i, j - i))
            raw += np.bincount(bins, minlength=BINS + 1)
            target += np.bincount(bins[wanted[i:j][rows]], minlength=BINS + 1)
        raw[BINS] += batch.num_rows
        target[BINS] += int(wanted.sum())
    at = np.flatnonzero(raw)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(part == BINS, -1, part).astype(np.int32)), pa.array(raw[part]), pa.array(target[part])], names=["bin", "raw", "target"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = 24_000, form_gate: float = 3.0, content_gate: float = 4.0) -> Model:
    """Both models from all documents, target and thresholds from at most ``sample`` labelled ones (see the module)."""
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    chosen = labels.select("doc_id", kind.alias("kind")).where("doc_id is not null and kind is not null").dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0
    chosen = materialize(chosen.withColumn("held", held), "labelled")  # at most `sample` rows
    rows = documents.select("doc_id", "text")
    marked = rows.join(F.broadcast(chosen), "doc_id", "left").select(((F.col("kind") == 0) & ~F.col("held")).alias("wanted"), "text")
    counts = marked.mapInArrow(_counted, "bin int, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = materialize(counts, "counts")  # a row a bin
    total = counts.where("bin = -1").first()
    if total is None or not total["target"]:
        return Model(np.empty(0, np.int64), np.empty(0))
    # raw counts at the target's size
    scaled = F.col("raw") * F.lit(total["target"] / total["raw"])
    gate = F.when(F.col("bin") >= FORMS, F.lit(form_gate)).otherwise(F.lit(content_gate))
    differ = counts.where("bin >= 0").where(F.abs(F.col("target") - scaled) >= gate * F.sqrt(scaled))
    got = differ.select("bin", F.log((F.col("target") + SMOOTHING) / (scaled + SMOOTHING)).alias("ratio")).orderBy("bin").collect()  # of a fixed number of bins those that differ
    model = Model(np.array([r["bin"] for r in got], np.int64), np.array([r["ratio"] for r in got]))

    def score(batches):
        dense = model.dense()
        for batch in batches:
            found = log_ratios(batch.column(2), dense)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "kind", "f", "c"])

    unseen = rows.join(F.broadcast(chosen.where("held")), "doc_id").select("doc_id", "kind", "text").mapInArrow(score, "doc_id long, kind int, f double, c double")
    seen = unseen.groupBy("doc_id").agg(F.min("kind").alias("kind"), F.min("f").alias("f"), F.min("c").alias("c")).collect()  # at most `sample` rows
    kinds, f, c = (np.array([r[k] for r in seen], float) for k in ("kind", "f", "c"))
    discard(chosen, counts)
    good, low, toxic = kinds == 0, kinds == 1, kinds == 2
    return Model(model.bins, model.ratios, threshold(f[good | low], good[good | low]), threshold(c[good | toxic], good[good | toxic]))


def _columns(model: Model, temperature: float, seed: int):
    """A function from (doc_id, text) to (log_weight, gumbel_key)."""

    @F.arrow_udf("log_weight double, gumbel_key double")
    def both(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        dense = model.dense()
        for ids, texts in parts:
            weight = weights(texts, model, dense)
            yield pa.StructArray.from_arrays([pa.array(weight), pa.array(weight / temperature + gumbel(ids, seed))], names=["log_weight", "gumbel_key"])

    return both


def scored(documents: DataFrame, model: Model, temperature: float, seed: int) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of every document."""
    return documents.select("doc_id", _columns(model, temperature, seed)("doc_id", "text").alias("s")).select("doc_id", "s.*")


def kth_largest(scores: DataFrame, column: str, k: int, buckets: int = 4096) -> float:
    """The k-th largest value, by histograms of ever narrower ranges: the driver holds ``buckets`` rows."""
    if k <= 0:
        return float("inf")
    low, high = scores.agg(F.min(column), F.max(column)).first()
    if low is None:
        return float("-inf")
    for _ in range(40):
        step = (high - low) / buckets
        if step <= 0 or low + step == low:
            return low
        inside = scores.where(F.col(column).between(low, high))
        slot = F.least(F.floor((F.col(column) - low) / step), F.lit(buckets - 1))
        rows = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        above = 0
        for r in sorted(rows, key=lambda r: -r["slot"]):
            if above + r["n"] >= k:
                k, low, high = k - above, r["lo"], r["hi"]
                break
            above += r["n"]
        if low == high:
            return low
    return low


def _least(scores: DataFrame, k: int | None, share: float | None, weight: str, key: str) -> float:
    """The smallest key that is kept."""
    if k is None:
        k = scores.where(F.col(weight) >= 0).count() if share is None else round(share * scores.count())
    return kth_largest(scores, key, k)


def resample(documents: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, temperature: float = 0.5, seed: int = 11, sample: int = 24_000) -> tuple[DataFrame, Model, float]:
    """(scores with kept, model, smallest kept key).

    ``k`` documents or a ``share`` of all are drawn; by default as many as reach the threshold.
    """
    model = fit(documents, labels, sample)
    scores = materialize(scored(documents, model, temperature, seed), "weights")
    least = _least(scores, k, share, "log_weight", "gumbel_key")
    return scores.withColumn("kept", F.col("gumbel_key") >= F.lit(least)), model, least


def keep_sampled(documents: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, temperature: float = 0.5, seed: int = 11, sample: int = 24_000) -> DataFrame:
    """The sampled documents with their columns; each text is scored once."""
    model = fit(documents, labels, sample)
    name = f"score_{uuid.uuid4().hex}"
    rows = materialize(documents.withColumn(name, _columns(model, temperature, seed)("doc_id", "text")), "weighed")
    least = _least(rows, k, share, f"{name}.log_weight", f"{name}.gumbel_key")
    return rows.where(F.col(f"{name}.gumbel_key") >= F.lit(least)).drop(name)


__all__ = ["Model", "features", "fit", "gumbel", "keep_sampled", "kth_largest", "log_ratios", "resample", "scored", "threshold", "weights"]
