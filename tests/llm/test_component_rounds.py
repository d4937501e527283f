"""Components: what a graph of stars costs, and results that are added to."""

import random

from quern.llm import components


def merged(groups, edges):
    """Sets of joined nodes, by node."""
    for a, b in edges:
        if a is not None:
            both = groups.get(a, {a}) | groups.get(b, {b})
            groups.update(dict.fromkeys(both, both))
    return groups


def test_stars_need_no_round(spark, monkeypatch):
    names, before = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: names.append(name) or before(df, name))
    edges = spark.createDataFrame([(x, x % 10) for x in range(10, 400)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {x: x % 10 for x in range(400)}
    assert len(names) == 1  # the edges themselves


def test_stars_are_added_to(spark):
    rng = random.Random(5)
    groups, known = {}, None
    for n in (60, 25, 1):
        edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(n)] + [(7, 7), (None, 3)]
        edges += edges[: n // 2]
        groups = merged(groups, edges)
        known = components.stars(spark.createDataFrame(edges, "a long, b long"), known)
        assert sorted(map(tuple, known.collect())) == sorted((x, min(g)) for x, g in groups.items() if x != min(g))


def test_chain(spark):
    """The longest way there is, in any order of names."""
    names = list(range(100))
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame(list(zip(names[:-1], names[1:], strict=True)), "a long, b long")
    assert sorted(map(tuple, components.components(edges).collect())) == [(x, 0) for x in range(100)]
