"""Repeated windows, against plain loops; the index against counting."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.fmindex import Bits, FMIndex, WaveletMatrix
from quern.llm.substring_dedup import MOST, repeated, segments, substring_dedup
from quern.llm.textkit import U, Words


def brute(rows, width):
    """doc_id and text by row; equal places are not earlier than each other."""
    place = lambda i, k: (i is None, i or 0, k)
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            first[s] = min(first.get(s, place(i, k)), place(i, k))
    out = []
    for i, w in split:
        gone = {k + x for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < place(i, k) for x in range(width)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@given(st.lists(st.integers(0, 9), max_size=300))
def test_wavelet_matrix(symbols):
    x = np.array(symbols, np.int64)
    matrix, bits = WaveletMatrix(x, 10), Bits(x % 2 == 1)
    for at in (0, len(x) // 3, len(x) // 2, len(x)):
        assert matrix.rank(np.arange(10), np.full(10, at)).tolist() == [symbols[:at].count(c) for c in range(10)]
        assert bits.rank(np.array([at]))[0] == sum(c % 2 for c in symbols[:at])


@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=20), min_size=1, max_size=6), st.integers(2, 6))
def test_backward_search(texts, depth):
    text = np.array([c for t in texts for c in (*t, 0)])
    index = FMIndex(text, depth)
    for size in range(1, depth + 1):
        for t in texts:
            for k in range(len(t) - size + 1):
                lo, hi = index.search(np.array([t[k : k + size]]))
                places = [x for x in range(len(text) - size + 1) if text[x : x + size].tolist() == t[k : k + size]]
                assert sorted(index.order[lo[0] : hi[0]].tolist()) == places
                if size == depth:
                    assert index.first(lo)[0] == places[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=25), min_size=1, max_size=7))
def test_masks(texts):
    seen, want = set(), []
    for t in texts:
        mask = 0
        for j in range(len(t) - 2):
            mask |= (tuple(t[j : j + 3]) in seen) << j
            seen.add(tuple(t[j : j + 3]))
        want.append(mask)
    places = np.array([(k, 0) for k in range(len(texts))])
    assert repeated([np.array(t, U) for t in texts], places, 3).tolist() == want


def test_segments_hold_every_window_once_and_equal_windows_share_anchors():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdef"), int(n))) for n in rng.integers(0, 200, 60)] + ["a " * 300, "a b c " * 70, ""]
    words = Words(pa.array(texts), lower=False)
    row, starts, n, anchor, key, times = segments(words, 20)
    begin = np.concatenate([[0], np.cumsum(words.counts())])
    held, anchors, keys = [], {}, {}
    for r, s, k, a, h, _ in zip(row.tolist(), starts.tolist(), n.tolist(), anchor.tolist(), key.tolist(), times.tolist(), strict=True):
        assert 0 < k <= MOST
        w = texts[r].split()
        held += [(r, s - begin[r] + j) for j in range(k)]
        for j in range(k):
            p = s - begin[r] + j
            assert anchors.setdefault(tuple(w[p : p + 20]), a) == a
        assert keys.setdefault(h, tuple(w[s - begin[r] : s - begin[r] + k + 19])) == tuple(w[s - begin[r] : s - begin[r] + k + 19])
    assert held == [(r, p) for r, t in enumerate(texts) for p in range(len(t.split()) - 19)]


def made():
    rng = np.random.default_rng(11)
    word = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "x"], n))
    passage = " ".join(f"p{k}" for k in range(60))
    copy = word(90)
    rows = [(k, f"{word(int(rng.integers(0, 40)))} {passage} {' '.join(f'u{k}_{x}' for x in range(30))}") for k in range(40)]
    rows += [(100 + k, copy) for k in range(30)] + [(200 + k, copy.replace("x", "y", k)) for k in range(12)]
    rows += [(300, "a " * 500), (301, "a\tb\n" * 90), (302, None), (303, ""), (304, " \n\t"), (305, "Ä" + " " + " b" * 30), (None, copy), (None, word(50)), (100, copy), (7, copy + " end")]
    rows += [(400, " ".join(f"w{x % 700}" for x in range(5000)))]
    return rows


@pytest.mark.parametrize("settings_", [{}, {"shard": 300}, {"hot": 3}, {"hot": 1, "shard": 200}, {"width": 8, "hot": 5}])
def test_against_loops(spark, settings_):
    rows = made()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, k string, start int").repartition(3)
    figures = {}
    found = substring_dedup(docs, figures=figures, **settings_)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, settings_.get("width", 20))
    assert figures["shards"] > 1 or "shard" not in settings_
    assert figures["hot anchors"] > 0 or "hot" not in settings_


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c")], [(2, "a " * 40), (2, "a " * 40)]])
def test_few_rows(spark, rows):
    found = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 20)
