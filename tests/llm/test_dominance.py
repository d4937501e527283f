"""Counts of rows above, against plain loops."""

import datetime as dt
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm.dominance import Fenwick, dominated, edges_of, sales_above

KINDS = "id string, slot long, level long, weight long"


def brute(rows):
    out = []
    for i, s, v, _ in rows:
        if s is None or v is None:
            out.append((i, s, v, None, None))
            continue
        above = [w or 0 for _, a, b, w in rows if a is not None and b is not None and a < s and b > v]
        out.append((i, s, v, len(above), sum(above)))
    return sorted(out, key=repr)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(-5, 9)), max_size=80), st.integers(1, 7))
def test_sweep(rows, tile):
    tree = Fenwick(31)
    places, weights = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    found = np.concatenate([tree.swept(places[a : a + tile], weights[a : a + tile]) for a in range(0, len(rows), tile)] or [np.zeros((0, 2), int)])
    want = [(sum(p < rows[i][0] for p, _ in rows[:i]), sum(w for p, w in rows[:i] if p < rows[i][0])) for i in range(len(rows))]
    assert found.tolist() == [list(x) for x in want]
    assert tree.totals().tolist() == [[sum(p < k for p, _ in rows), sum(w for p, w in rows if p < k)] for k in range(31)]


def test_repeated_cuts_are_ranges_of_one_slot():
    ends, single = edges_of([1, 4, 4, 4, 9])
    assert ends.tolist() == [2, 4, 5, 10] and single.tolist() == [False, False, True, False, False]
    assert edges_of([])[1].tolist() == [False]


@pytest.mark.parametrize("ranges", [1, 2, 5, 64])
def test_against_loops(spark, ranges):
    rng = np.random.default_rng(ranges)
    rows = []
    for k in range(500):  # a third has one slot, a third one level; ties, nulls, negative and wide values
        slot = 7 if k % 3 == 0 else int(rng.integers(-20, 20)) * 10 ** int(rng.integers(0, 9))
        level = 3 if k % 3 == 1 else int(rng.integers(-6, 6)) * 10 ** int(rng.integers(0, 12))
        rows.append((f"r{k % 490}", None if k % 41 == 0 else slot, None if k % 43 == 0 else level, None if k % 47 == 0 else int(rng.integers(0, 5))))
    found = dominated(spark.createDataFrame(rows, KINDS).repartition(3), ranges)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("rows", [[], [("a", 1, 1, 1)], [("a", None, 1, 1)], [("a", 1, 1, 1)] * 5, [(None, 1, 5, 2), (None, 2, 4, 1)]])
def test_few_rows(spark, rows):
    assert sorted(map(tuple, dominated(spark.createDataFrame(rows, KINDS)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_sales_in_any_zone(spark, zone):
    times = [dt.datetime(2024, 3, 10, 2, 30, 59, 999999), dt.datetime(2024, 3, 10, 2, 31), dt.datetime(1969, 12, 31, 23, 59, 30), None]
    rows = [(k, times[k % 4], [1.005, float("nan"), None, 2.675, 0.0][k % 5], k) for k in range(40)] + [(None, times[1], 0.5, 1)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        found = {(r.sale_id, r.level): r for r in sales_above(spark.createDataFrame(rows, "sale_id long, sold_at timestamp_ntz, total double, slot long")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    plain = []
    for i, t, v, _ in rows:
        slot = None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=1)
        level = None if v is None or v != v else int(np.floor(100 * v + 0.5))
        plain.append((i, slot, level, 1 + zlib.crc32(b"" if i is None else str(i).encode()) % 5))
    for i, s, v, n, w in brute(plain):
        r = found[i, v]
        assert (r.slot, r.n_sales, r.n_rows) == (s, n, w)
