"""Full searches give a pair once, and only if its sets share enough of their prefixes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import jaccard_join


@pytest.mark.parametrize("least", [3, 32])
def test_pairs_once(monkeypatch, least):
    monkeypatch.setattr(jaccard_join, "ABREAST", 50)
    rng, n = random.Random(least), 100
    common = [rng.getrandbits(63) - (1 << 62) for _ in range(60)]
    # half share a single key, of the others each has 8 to 20 of 24; the points are equal and rule nothing out
    sets = [set(rng.sample(common[:24], rng.randrange(8, 20))) if s % 2 else {common[s], common[59]} for s in range(40)]
    point = np.full(jaccard_join.GROUPS, 2, np.uint8).tobytes()
    rows = [(key, s) for key in common for s in range(40) if key in sets[s]]
    columns = {"key": [k for k, _ in rows], "i": [0] * len(rows), "j": [0] * len(rows), "sid": [s for _, s in rows], "n": [n] * len(rows), "comp": [s for _, s in rows], "side": [-1] * len(rows), "point": [point] * len(rows)}
    columns |= {"many": [len(sets[s]) for _, s in rows], "least": [sorted(sets[s])[:least] for _, s in rows]}
    order = sorted(range(len(rows)), key=lambda k: rows[k])
    batch = pa.table(columns).take(order).to_batches()
    got = [r for b in jaccard_join._trees(80, 100)(batch) for r in b.to_pylist() if r["a"] is not None]
    want = {(a, b): len(sets[a] & sets[b]) for a in range(40) for b in range(a + 1, 40) if sets[a] & sets[b] and (len(sets[a] & sets[b]) + 79) * 180 >= 200 * 80}
    pairs = [(r["a"], r["b"]) for r in got]
    assert 20 < len(want) < 190 and set(want) <= set(pairs) and all(r["c"] >= want.get((r["a"], r["b"]), 0) for r in got)
    if least == 32:
        assert len(pairs) == len(set(pairs)) and {(r["a"], r["b"]): r["c"] for r in got} == want
    else:
        assert all(sets[a] & sets[b] for a, b in pairs) and len(pairs) < sum(len(sets[a] & sets[b]) for a in range(40) for b in range(a + 1, 40))
