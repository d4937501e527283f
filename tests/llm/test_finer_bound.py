"""Pairs that a finer bound rules out are no links, and the bound rules out what shares little."""

import numpy as np
import pyarrow as pa

from quern.llm import jaccard_join
from quern.llm.textkit import U


def test_odd_bits():
    rng = np.random.default_rng(3)
    for shared, own in [(0, 400), (300, 100), (380, 20), (400, 0), (5_000, 9_000)]:
        pool = np.unique(rng.integers(0, 1 << 63, shared + 2 * own).astype(U))
        a, b = pool[: shared + own], np.concatenate([pool[:shared], pool[shared + own :]])
        apart = int(np.bitwise_count((jaccard_join._odd(a) ^ jaccard_join._odd(b)).view(U)).sum())
        assert apart <= 2 * own
        if shared + own <= 400:
            assert (apart * 180 <= (len(a) + len(b)) * 20) == (shared * 100 >= 80 * (shared + 2 * own))


def test_sets_once():
    texts = pa.array(["a b c d e f", "x y", "a b c d e f", None])
    rows = [r for b in jaccard_join._full(5)([pa.record_batch([texts], ["text"])] * 2) for r in b.to_pylist()]
    assert [r["n"] for r in rows if r["n"]] == [2, 1] and all(len(r["hashes"]) == r["n"] and len(r["odd"]) * 64 == jaccard_join.FINE for r in rows)
