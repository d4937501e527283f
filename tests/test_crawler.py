"""The crawl stream against the batch traversal: depth, restart, delay, budget, robots rules."""

import collections
import time

import pytest

from quern.plans.crawl import traverse
from quern.streaming import crawler

LINKS = [(f"http://h{a % 3}.org/{a}", f"http://h{b % 3}.org/{b}") for a in range(30) for b in ((a * 7 + 1) % 40, (a * 3 + 2) % 40, (a * a) % 40)]
START = "http://h1.org/1"


def graph(spark):
    return spark.createDataFrame(LINKS, "src string, dst string"), spark.createDataFrame([(START,)], "url string")


def plain(rows):
    return sorted((r["url"], r["depth"]) for r in rows)


def test_stream_equals_traversal_and_survives_a_restart(spark, tmp_path):
    links, start = graph(spark)
    want = plain(traverse(links, start, 4).collect())
    folder = f"file://{tmp_path}/c"
    crawler.begin(start, folder)
    first = crawler.started(spark, links, folder, 4, files=1)
    until = time.time() + 120
    while time.time() < until and not (first.lastProgress and first.lastProgress["batchId"] >= 1):
        time.sleep(0.05)
    first.stop()
    before = plain(crawler.done(spark, folder).collect())
    crawler.begin(start, folder)  # harmless
    got = crawler.finished(spark, crawler.started(spark, links, folder, 4, lanes=1), folder, 300)
    assert plain(got.collect()) == want and set(before) <= set(want) and 0 < len(before)


def test_delay_budget_and_rules(spark, tmp_path):
    links, start = graph(spark)
    rules = spark.createDataFrame([("http://h2.org", "disallow", "/2")], "origin string, kind string, pattern string")
    delays = spark.createDataFrame([("h0.org", 300), ("h1.org", 200)], "host string, delay int")
    folder = f"file://{tmp_path}/c"
    crawler.begin(start, folder)
    found = crawler.finished(spark, crawler.started(spark, links, folder, 9, rules, delays, budget=6), folder, 300).collect()
    by_host = collections.defaultdict(list)
    for r in found:
        by_host[r["host"]].append(r["at"])
    assert all(len(x) <= 6 for x in by_host.values()) and len(by_host["h1.org"]) == 6
    for host, gap in (("h0.org", 300), ("h1.org", 200)):
        times = sorted(by_host[host])
        assert all(b - a >= gap for a, b in zip(times, times[1:], strict=False))
    assert not [r for r in found if r["url"].startswith("http://h2.org/2")]
    assert len({r["url"] for r in found}) == len(found)


def test_it_says_when_time_is_over(spark, tmp_path):
    links, start = graph(spark)
    folder = f"file://{tmp_path}/c"
    crawler.begin(start, folder)
    with pytest.raises(TimeoutError):
        crawler.finished(spark, crawler.started(spark, links, folder, 2), folder, 0.2)
