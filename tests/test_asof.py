"""As-of joins and pinned requests against plain loops."""

import random

import pytest

from quern.plans import asof


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_asof(spark, width):
    rng = random.Random(int(width))
    key = lambda: rng.choice(["a", "b", "c", None])
    when = lambda: rng.choice([None, *map(float, range(40))])
    left = [(k, key(), when()) for k in range(200)]
    right = [(key(), when(), k, rng.choice([None, float(rng.randrange(50))]), f"v{k}") for k in range(60)]
    found = asof.asof(spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "k string, t double, tie int, until double, v string"), "k", "t", "tie", width, "until")
    want = []
    for i, k, t in left:
        held = max(((rt, tie, until, v) for rk, rt, tie, until, v in right if rk == k and rk is not None and rt is not None and t is not None and rt <= t), key=lambda x: x[:2], default=None)
        want.append((i, held[3] if held and (held[2] is None or t < held[2]) else None))
    assert sorted((r.id, r.held.v if r.held else None) for r in found.collect()) == sorted(want)


def test_pinned(spark):
    answers = [
        ("a.org", 0.0, 1, None, ["93.184.1.1", "93.184.1.2"]), ("a.org", 10.0, 2, None, ["93.184.1.2"]), ("b.org", 0.0, 1, 5.0, ["93.184.2.1"]), ("c.org", 0.0, 1, None, ["93.184.3.1", "169.254.1.1"]),
        ("d.org", 0.0, 1, None, ["2001:db8::1"]), ("d.org", 3.0, 2, None, ["2001:db8::1", "::ffff:169.254.0.1"]), ("e.org", 0.0, 1, None, []), ("f.org", 0.0, 1, None, None), ("p.org", 0.0, 1, None, ["10.0.0.1"]),
    ]
    asked = [(1, "a.org", 1.0, 2.0), (2, "a.org", 1.0, 11.0), (3, "a.org", 10.0, 11.0), (4, "b.org", 1.0, 2.0), (5, "b.org", 1.0, 6.0), (6, "b.org", 5.0, 5.0), (7, "c.org", 1.0, 1.0), (8, "d.org", 1.0, 2.0), (9, "d.org", 1.0, 4.0), (10, "e.org", 1.0, 1.0), (11, "f.org", 1.0, 1.0), (12, "x.org", 1.0, 1.0), (13, None, 1.0, 1.0), (14, "p.org", 1.0, 1.0)]
    rows, known = spark.createDataFrame(asked, "id int, host string, checked_at double, fetched_at double"), spark.createDataFrame(answers, "host string, at double, tie int, until double, addresses array<string>")
    got = {r.id: r.address or r.refusal for r in asof.pinned(rows, known, width=4.0).collect()}
    assert got == {
        1: "93.184.1.1", 2: "changed", 3: "93.184.1.2", 4: "93.184.2.1", 5: "changed", 6: "unresolved", 7: "network", 8: "2001:db8::1", 9: "changed",
        10: "unresolved", 11: "unresolved", 12: "unresolved", 13: "unresolved", 14: "10.0.0.1",
    }
    assert {r.id: r.refusal for r in asof.pinned(rows, known, strict=True).collect()}[14] == "network"
