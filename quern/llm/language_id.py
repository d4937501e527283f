"""Operator 3: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
likelihood of a word is the sum over all its segmentations into pieces of the product
of the pieces' probabilities, computed by a forward pass; a text's is the product
over its words.  The prediction is the language under which the text is likeliest
(languages weigh the same beforehand), its score that language's share.

Probabilities are fitted by expectation maximisation with forward-backward counts
over all segmentations, smoothed towards the vocabulary's rank law.  Fitting takes a
bounded sample: of each language at most ``sample`` labelled documents, the first by a
hash of doc_id; what tasks return is one count per piece and language.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case,
each with a ``▁`` in front.  Words of up to ``LONGEST`` characters go through the forward
pass side by side, longer ones one by one with rescaled sums: of any word all
segmentations count.  Fitting alone takes longer words in parts of ``LONGEST``, so that
its backward pass stays in range.

Defined results: null text and text without a letter are ``und`` with score 0; with
nothing to learn from, everything is ``und``; ties go to the first language by name;
lang, source and doc_id are no inputs of a prediction; other columns do not matter.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.lattice import SPACE, Batch, Pieces, codepoints, default_model, load
from quern.llm.sized import small
from quern.llm.textkit import ALNUM, U, Words, slices, views
from quern.scratch import discard, materialize

LONGEST = 40
#: Characters of a long word whose pieces are looked up at once, and places after which sums are rescaled.
STRETCH, RESCALE = 8192, 32
ROUNDS = 3
PRIOR = 2000.0
#: Keeps products of probabilities within range; every character brings it once.
BOOST = 12.0
FORGET = 400_000
SHARE_BITS = 12
_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = True


def parts(words: list[bytes]) -> tuple[list[str], np.ndarray]:
    """(segments of at most LONGEST characters, word of each)."""
    out, rows = [], []
    for k, w in enumerate(words):
        t = SPACE + w.decode("utf-8", "replace")
        if len(t) <= LONGEST:
            out.append(t)
            rows.append(k)
        else:
            cut = [t[i : i + LONGEST] for i in range(0, len(t), LONGEST)]
            out += cut
            rows += [k] * len(cut)
    return out, np.array(rows, np.int64)


def _weights(v: Pieces, p: np.ndarray) -> np.ndarray:
    """Boosted probabilities [piece + 1, language]; the last row is of a character without a piece."""
    length = np.array([len(x) for x in v.pieces])
    out = p * (BOOST ** np.minimum(length, v.longest))[:, None]
    return np.concatenate([out, np.full((1, p.shape[1]), 1e-9 * BOOST)])


def _gain(batch: Batch, weights: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    ids = batch.ids[length - 1, at]
    gain = weights[ids]
    if length > 1:
        gain[ids < 0] = 0.0
    return gain


def forward(batch: Batch, weights: np.ndarray) -> np.ndarray:
    """alpha[place, segment, language], segments longest first."""
    alpha = np.zeros((batch.steps + 1, len(batch.texts), weights.shape[1]))
    alpha[0] = 1.0
    for p in range(1, batch.steps + 1):
        m = int(batch.reach[p])
        for length in range(1, min(p, batch.vocabulary.longest) + 1):
            alpha[p, :m] += alpha[p - length, :m] * _gain(batch, weights, length, batch.starts[:m] + p - length)
    return alpha


def log_likelihood(v: Pieces, texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Natural logarithms [segment, language], summed over all segmentations."""
    out = np.empty((len(texts), weights.shape[1]))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    short = np.flatnonzero(size <= LONGEST + 1)
    for a in range(0, len(short), 8192):
        part = short[a : a + 8192]
        batch = Batch(v, [texts[k] for k in part.tolist()])
        last = forward(batch, weights)[batch.lengths, np.arange(len(batch.texts))]
        out[part[batch.order]] = np.log(np.maximum(last, 1e-300)) - (batch.lengths * np.log(BOOST))[:, None]
    for k in np.flatnonzero(size > LONGEST + 1).tolist():
        out[k] = _long(v, texts[k], weights)
    return out


def _long(v: Pieces, text: str, weights: np.ndarray) -> np.ndarray:
    """The same of one segment of any length; of the sums only those that a piece can reach back to are kept."""
    s = v.longest
    window = np.zeros((s, weights.shape[1]))  # sums of the last s places, the latest last
    window[-1] = 1.0
    logs = np.zeros(weights.shape[1])
    back = np.arange(s, 0, -1)
    for a in range(0, len(text), STRETCH):
        cps, _ = codepoints([text[max(0, a - s) : a + STRETCH]])
        lead = min(a, s)
        ids = v.lookup(cps, len(cps) - np.arange(len(cps)))
        places = np.arange(lead, len(cps)) + 1
        start = places[:, None] - back  # a piece of back[j] characters ends at each place
        found = np.where(start >= 0, ids[back - 1, np.maximum(start, 0)], -1)
        gain = weights[found]
        gain[:, :-1][found[:, :-1] < 0] = 0.0  # only a single character may be without a piece
        n = len(gain)
        alpha = np.concatenate([window, np.empty((n, weights.shape[1]))])
        for p in range(n):
            np.einsum("kl,kl->l", gain[p], alpha[p : p + s], out=alpha[p + s])
            if p % RESCALE == RESCALE - 1:
                scale = np.maximum(alpha[p + s], 1e-300)
                alpha[p + 1 : p + s + 1] /= scale
                logs += np.log(scale)
        window = alpha[-s:]
    return np.log(np.maximum(window[-1], 1e-300)) + logs - len(text) * np.log(BOOST)


def expected_counts(v: Pieces, texts: list[str], times: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations, under one language's weights."""
    counts = np.zeros(v.size)
    for a in range(0, len(texts), 8192):
        batch = Batch(v, texts[a : a + 8192])
        alpha = forward(batch, weights)[:, :, 0]
        n = len(batch.texts)
        beta = np.zeros((batch.steps + 1, n))
        beta[batch.lengths, np.arange(n)] = 1.0
        scale = times[a : a + 8192][batch.order] / np.maximum(alpha[batch.lengths, np.arange(n)], 1e-300)
        for p in range(batch.steps, 0, -1):
            m = int(batch.reach[p])
            for length in range(1, min(p, v.longest) + 1):
                at = batch.starts[:m] + p - length
                gain = _gain(batch, weights, length, at)[:, 0] * beta[p, :m]
                beta[p - length, :m] += gain
                ids = batch.ids[length - 1, at]
                hit = ids >= 0
                np.add.at(counts, ids[hit], (alpha[p - length, :m] * gain * scale[:m])[hit])
    return counts


@dataclass(frozen=True)
class Model:
    languages: list[str]
    p: np.ndarray
    path: str


def _rank_law(v: Pieces) -> np.ndarray:
    q = np.zeros(v.size)
    q[v.ids] = np.exp(v.scores[v.ids] / (1 << 20))
    return q / q.sum()


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang) of the first ``sample`` rows of each language by a hash.

    Rows are counted by ranges of the hash, so only those of the one range that is cut are sorted.
    """
    h = F.xxhash64("doc_id")
    rows = rows.withColumns({"h": h, "share": F.shiftrightunsigned(h, 64 - SHARE_BITS)})
    counts = rows.groupBy("lang", "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("share")) - F.col("n")  # a row a range
    ranges = counts.withColumn("room", sample - before).where("room > 0").select("lang", "share", "n", "room")
    rows = rows.join(small(ranges), ["lang", "share"])
    cut = rows.where("n > room").withColumn("k", F.row_number().over(Window.partitionBy("lang", "share").orderBy(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), "doc_id"))).where("k <= room")
    return rows.where("n <= room").select("doc_id", "lang").union(cut.select("doc_id", "lang"))


def fit(labelled: DataFrame, path: str | None = None, sample: int = 6000) -> Model:
    """Model of the languages in (doc_id, text, lang); at most ``sample`` documents of each are used."""
    path = path or default_model()
    v = load(path)
    chosen = _sampled(labelled.where("lang is not null").select("doc_id", "lang"), sample)
    # at most `sample` rows a language
    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen.dropDuplicates()), ["doc_id", "lang"], "left_semi")
    # dealt evenly, since a small table may be one file
    dealt = min(16, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(rows.select("lang", "text").repartition(dealt), "sample")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    prior = _rank_law(v)
    p = np.repeat(prior[:, None], len(languages), axis=1)
    for _ in range(ROUNDS if languages else 0):

        def expect(batches, p=p):
            total = np.zeros_like(p)
            for batch in batches:
                lang = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
                for i, j in slices(batch.column(1)):
                    w = Words(batch.column(1).slice(i, j - i), ALNUM)
                    for k in np.unique(lang[i:j]).tolist():
                        rows_k = np.flatnonzero(lang[i:j][w.row] == k)
                        _, first, times = np.unique(w.hash[rows_k], return_index=True, return_counts=True)
                        texts, word = parts(w.texts(rows_k[first]))
                        if texts:
                            total[:, k] += expected_counts(v, texts, times[word].astype(float), _weights(v, p[:, k : k + 1]))
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(piece, pa.int64()), pa.array(total[piece, k])], names=["k", "piece", "c"])

        # one row for each of the vocabulary's pieces and each language at most
        got = rows.mapInArrow(expect, "k long, piece long, c double").groupBy("k", "piece").agg(F.sum("c").alias("c")).toPandas()
        counts = np.zeros_like(p)
        counts[got["piece"].to_numpy(int), got["k"].to_numpy(int)] = got["c"].to_numpy(float)
        p = (counts + PRIOR * prior[:, None]) / (counts.sum(axis=0) + PRIOR)
    discard(rows)
    return Model(languages, p, path)


class Known:
    """Log likelihoods of words by hash; beyond ``FORGET`` words those used least are forgotten."""

    def __init__(self, v: Pieces, weights: np.ndarray):
        self.v, self.weights = v, weights
        self.keys, self.values, self.uses = np.empty(0, U), np.empty((0, weights.shape[1])), np.empty(0, np.int64)

    def __call__(self, words: Words) -> np.ndarray:
        """[word, language]"""
        distinct, first, back, times = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
        if len(self.keys) > FORGET:
            kept = np.sort(np.argsort(-self.uses, kind="stable")[: FORGET // 3])
            self.keys, self.values, self.uses = self.keys[kept], self.values[kept], self.uses[kept] // 2
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            texts = [SPACE + w.decode("utf-8", "replace") for w in words.texts(first[new])]
            made = log_likelihood(self.v, texts, self.weights)
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate([self.values, made])[order]
            self.uses = np.concatenate([self.uses, np.zeros(len(made), np.int64)])[order]
            at = np.searchsorted(self.keys, distinct)
        self.uses[at] += times
        return self.values[at][back]


_KEPT: dict[str, Known] = {}


def _kept(name: str, pieces: list[str], p: np.ndarray) -> Known:
    """The model's words, which a worker keeps from task to task."""
    if name not in _KEPT:
        _KEPT.clear()
        v = Pieces(pieces)
        _KEPT[name] = Known(v, _weights(v, p))
    return _KEPT[name]


def has_letter(texts: pa.Array) -> np.ndarray:
    raw, offsets = views(texts)
    sums = np.concatenate([[0], np.cumsum(_LETTERS[raw])])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for r in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[r] = any(map(str.isalpha, texts[r].as_py()))
    return out


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    languages, p, path = model.languages, model.p, model.path
    pieces, name = load(path).pieces, uuid.uuid4().hex

    def run(batches):
        known = _kept(name, pieces, p)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                texts = batch.column(1).slice(i, j - i)
                names, scores = [None] * (j - i), np.zeros(j - i)
                letters = has_letter(texts)
                if languages:
                    w = Words(texts, ALNUM)
                    each = known(w)
                    total = np.stack([np.bincount(w.row, each[:, k], j - i) for k in range(len(languages))], axis=1)
                    share = np.exp(total - total.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    best = share.argmax(axis=1)
                    names = [languages[b] for b in best.tolist()]
                    scores = share[np.arange(j - i), best]
                ok = letters & bool(languages)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([n if k else "und" for n, k in zip(names, ok.tolist(), strict=True)], pa.string()), pa.array(np.where(ok, scores, 0.0))], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from documents that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(documents.where(~held), path)
    return predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
