import random

import pyarrow as pa

from quern.llm import fingerprint


def shingle_set(t):
    w = t.split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def exact(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_near_edited_of_short_texts(spark):
    """Texts of up to WHOLE shingles are compared exactly, longer ones within the sketch's error."""
    rng = random.Random(12)
    sizes = [1, 4, 5, 6, 9, 12, 15, 15, 15, 15, 18, 20, 25, 30, 40, 60, 100, 150, 200, 230, 250, 256, 260, 262, 265, 400, 900]
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in sizes]
    texts += [texts[8] + " more", texts[13] + " more"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.neighbours(rows).collect()}
    tried = 0
    for i, t in enumerate(texts):
        following = texts[i - 1]  # ids descend, and the first meets the last
        for field, other in (("near_edited", fingerprint.edited(t, following)), ("near_next", following)):
            short = max(len(shingle_set(t)), len(shingle_set(other))) <= fingerprint.WHOLE
            tried += short
            assert abs(got[i][field] - exact(t, other)) <= (1e-12 if short else 0.3), (i, field)
    assert tried > 40


def test_near_copies_of_short_texts():
    rng = random.Random(3)
    for n in range(5, 60):
        t = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
        a, b = fingerprint.fingerprints(pa.array([t, t + " more"]))
        assert fingerprint.likeness(a, b) == exact(t, t + " more") and fingerprint.containment(a, b) == 1.0


def test_merged_short_and_long():
    """Parts that keep all merge into what the whole keeps, on either side of the bound."""
    rng = random.Random(4)
    w = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    for first, last in ((100, 200), (150, 400), (200, 900), (600, 900)):
        parts = fingerprint.fingerprints(pa.array([" ".join(w[:first]), " ".join(w[first - 4 : last])]))
        whole = fingerprint.fingerprints(pa.array([" ".join(w[:last])]))[0]
        made = fingerprint.merged(*parts)
        assert made == whole and fingerprint.merged(parts[1], parts[0]) == whole
        assert whole.startswith("all:") == (last - 4 <= fingerprint.WHOLE)


def test_likeness_and_containment_against_exact():
    """What both keep decides: exact for small sets, else the kept shares themselves."""
    rng = random.Random(5)
    for _ in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 500))]
        x = w[: rng.randrange(1, len(w) + 1)] + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        a, b = " ".join(w), " ".join(x)
        fa, fb = fingerprint.fingerprints(pa.array([a, b]))
        sa, sb = shingle_set(a), shingle_set(b)
        if max(len(sa), len(sb)) <= fingerprint.WHOLE:
            assert abs(fingerprint.likeness(fa, fb) - len(sa & sb) / len(sa | sb)) < 1e-12
            assert abs(fingerprint.containment(fa, fb) - len(sa & sb) / len(sa)) < 1e-12
        else:
            ka, kb = ({h for h in (p[k : k + 10] for p in [f.split(":")[1]] for k in range(0, len(p), 10)) if int(h, 16) < 2**40 // 8} for f in (fa, fb))
            if fa != fb and fa[:3] == fb[:3]:
                assert fingerprint.likeness(fa, fb) == (len(ka & kb) / len(ka | kb) if ka | kb else 0.0)
    assert fingerprint.fingerprints(pa.array([None, "", " \n"])) == ["all:"] * 3 and fingerprint.likeness("all:", "all:") == 1.0
