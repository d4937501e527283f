"""Ranked search against plain loops over all documents."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.llm.lexical_search import _numbered, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def brute(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in collections.Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def made():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "éa9", "THE", "a"]
    weights = 1 / np.arange(1, 65)
    text = lambda n: " ".join(rng.choice(vocabulary[::-1], n, p=weights / weights.sum()))
    docs = [(k, text(int(rng.integers(0, 80)))) for k in range(300)] + [(1000 + k, "the w1 w2") for k in range(50)]
    docs += [(2000, None), (2001, ""), (2002, "-- !! @"), (None, "w5 w6 w7 w8"), (5, "w5 w5"), (5, "w5 w5"), (2003, "w9 " * 3000), (2004, text(4000))]
    items = [(k, text(int(rng.integers(1, 30)))) for k in range(25)] + [(100, None), (101, ""), (102, "nowhere"), (103, "w1 W1 w1,w2"), (103, "w1 W1 w1,w2"), (103, "other w3"), (None, "w4 a"), (104, "the"), (105, "nowhere w59")]
    return docs, items


@pytest.mark.parametrize("k, size", [(20, 1 << 19), (3, 150)])
def test_against_loops(spark, k, size):
    docs, items = made()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, t string").repartition(4)
    figures = {}
    found = search(frame, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, q int"), k, size, figures)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, k)
    assert figures["candidates"] <= len(docs) * len(items) and figures["fetched"] <= figures["entries"]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, "a"), (2, "a b"), (3, None)], [(1, "b b a"), (2, None)])])
def test_few_rows(spark, docs, items):
    found = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, 20)


def test_lists_are_numbered_across_batches():
    made = [pa.RecordBatch.from_pydict({"t": pa.array(t, pa.int64())}) for t in ([1, 1, 2], [2, 2], [2, 3, 3], [], [4])]
    assert [b.column("at").to_pylist() for b in _numbered(iter(made))] == [[0, 1, 0], [1, 2], [3, 0, 1], [0]]
