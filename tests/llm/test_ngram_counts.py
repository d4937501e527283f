import collections
import math
import random
import zlib

import numpy as np
import pytest

from quern.llm import ngram_trie
from quern.llm.queries import op9_ngram_trie


@pytest.mark.parametrize("per_file", [2_000_000, 30])
def test_query_scores_with_all_counts(spark, tmp_path, monkeypatch, per_file):
    """N-grams that occur once in the training texts take part, also where files cut through a context."""
    monkeypatch.setattr(ngram_trie, "PER_FILE", per_file)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op9_ngram_trie(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = [*t.split(), None]
            p = [None, *w]
            one.update(w)
            two.update(zip(p, p[1:]))
            three.update(zip(p, p[1:], p[2:]))
    n, v = sum(one.values()), len(one)
    assert sum(c == 1 for c in two.values()) > 100 and sum(c == 1 for c in three.values()) > 100
    used, after = collections.Counter(), collections.Counter()
    for x in (two, three):
        for k, c in x.items():
            used[k[:-1]] += c - ngram_trie.DISCOUNT
            after[k[:-1]] += c
    assert all(after[k] == c for k, c in two.items() if k[-1] is not None)
    for i, t in rows:
        w, model = [*t.split(), None], 0.0
        p = [None, *w]
        for k, x in enumerate(w):
            q = (one[x] + 1) / (n + v + 1)
            for gram, below in (((p[k], x), one[p[k]]), ((p[k - 1], p[k], x) if k else None, two[p[k - 1], p[k]] if k else 0)):
                if below:
                    counted = (two if len(gram) == 2 else three)[gram]
                    q = (1 - used[gram[:-1]] / below) * q + max(0, counted - ngram_trie.DISCOUNT) / below
            model += math.log10(q)
        assert got[i]["held_out"] == held(i) and abs(got[i]["score"] - model) / len(w) < 0.03, i


def test_keys_that_do_not_fit_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie.Trie, "bits", property(lambda self: 62))
    rows = spark.createDataFrame([(i, f"a{i} b c") for i in range(20)], "doc_id long, text string")
    with pytest.raises(ValueError, match="64 bits"):
        ngram_trie.scored(rows)


def test_quantised_values_keep_small_probabilities():
    p = 10.0 ** -np.linspace(0, 13.8, 2000)
    back = 10.0 ** -ngram_trie.ORDERS[ngram_trie._quantised(p)]
    assert (np.abs(np.log10(back / p)) <= np.where(p > 1.1e-6, 0.5 / 32, 0.5 / 8) + 1e-9).all()
