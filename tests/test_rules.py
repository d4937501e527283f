"""Rules on small inputs: reasoning, readability, addresses, validators, running values, medians, the streamed cache."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import images, urls, validators
from quern.operators import passages
from quern.operators.dom import parse
from quern.operators.markdown import convert
from quern.operators.readability import pick
from quern.plans import states
from quern.plans.running import medians, running
from quern.sources import readers, search
from quern.streaming import policies


@pytest.mark.parametrize(
    ("reply", "answer"),
    [
        ("<think>x</think> yes", "yes"), ("  <THINK a='1'>x</Think>\n{1}", "{1}"), ("<think>a <think>b</think> c</think> d", "d"), ("<think>only thoughts", "<think>only thoughts"),
        ("the tag </think> in prose, answer", "the tag </think> in prose, answer"), ("say <think>x</think>", "say <think>x</think>"), ("</think> tail", "</think> tail"), ("", ""),
        ("<think>a</think> use </think> here", "use </think> here"), ("<thinking>a</thinking> b", "<thinking>a</thinking> b"),
    ],
)
def test_without_reasoning(reply, answer):
    assert passages.without_reasoning(reply) == answer


def test_readable_part():
    prose = "<div class='story'>" + "<p>Prose with some words, and more of them, for a reader.</p>" * 12 + "</div>"
    page = f"<body><div class='menu'>{'<a href=/x>a link of the day</a> ' * 30}</div>{prose}</body>"
    found = pick(parse(page), parse(page))
    assert found is not None and "Prose with" in found.text(" ") and "link of the day" not in found.text(" ")
    assert pick(parse(page), parse("<body><p>other words only</p></body>")) is None  # cleaning removed it
    assert pick(parse("<body><p>too short, by far, to be read</p></body>"), parse("<body></body>")) is None
    assert "link of the day" not in convert(page)[0]


@pytest.mark.parametrize(
    ("host", "always", "strict"),
    [
        ("169.254.169.254", True, True), ("::ffff:169.254.1.1", True, True), ("2002:a9fe:a9fe::", True, True), ("64:ff9b::a9fe:a9fe", True, True), ("::169.254.169.254", True, True), ("fe80::1", True, True),
        ("10.0.0.1", False, True), ("::1", False, True), ("::", False, True), ("fd00::1", False, True), ("8.8.8.8", False, False), ("a.org", False, False), (None, False, False), ("2001:db8::1", False, False),
    ],
)
def test_blocked_addresses(host, always, strict):
    assert (urls.blocked(host), urls.blocked(host, True)) == (always, strict)


@pytest.mark.parametrize(
    "call, want",
    [
        (lambda v: v.urls('["http://a.org", "http://a.org", "https://b.org/x"]'), ["http://a.org", "http://a.org", "https://b.org/x"]), (lambda v: v.urls(" http://a.org "), ["http://a.org"]), (lambda v: v.urls([]), None), (lambda v: v.urls(["x"]), None),
        (lambda v: v.urls(["http://a.org"] * 101), None), (lambda v: v.urls('["http://a.org"'), None), (lambda v: v.urls(None), None), (lambda v: v.url("HTTP://a.org"), None), (lambda v: v.url("http://"), None), (lambda v: v.url("http://[::1"), None),
        (lambda v: v.url("http://169.254.169.254/x"), None), (lambda v: v.url("http://10.0.0.1"), "http://10.0.0.1"), (lambda v: v.url("http://10.0.0.1", strict=True), None), (lambda v: v.url("http://a.org\\@b.org"), None), (lambda v: v.url("http://ä.org"), None),
        (lambda v: v.query("..."), "..."), (lambda v: v.query("x" * 1000), "x" * 1000), (lambda v: v.query("x" * 1001), None), (lambda v: v.query("  "), None), (lambda v: v.query(5), None),
        (lambda v: v.prompt("x" * 9), None), (lambda v: v.prompt(" " + "x" * 10), "x" * 10), (lambda v: v.prompt("x" * 10_001), None), (lambda v: v.timeout("1500"), 1500), (lambda v: v.timeout(1500.9), 1500), (lambda v: v.timeout(999), None), (lambda v: v.timeout(300_001), None), (lambda v: v.timeout("x"), None), (lambda v: v.timeout([1]), None),
        (lambda v: v.limit(100), 100), (lambda v: v.limit(101), None), (lambda v: v.limit(0), None), (lambda v: v.limit("5"), 5), (lambda v: v.limit(True), None), (lambda v: v.limit(1.5), None), (lambda v: v.limit(None, default=7), 7), (lambda v: v.limit(5_000, most=10_000), 5_000),
        (lambda v: v.steps(0), 1), (lambda v: v.steps(50), 20), (lambda v: v.steps(None), 10), (lambda v: v.steps("many"), 10), (lambda v: v.steps("7"), 7), (lambda v: v.steps(-3), 1), (lambda v: v.steps(3.9), 3), (lambda v: v.steps(float("inf")), 10),
        (lambda v: v.formats(["gif"]), None), (lambda v: v.formats("html"), None), (lambda v: v.formats([]), []), (lambda v: v.formats(["html", "html"]), ["html", "html"]), (lambda v: v.formats(["pdf"], known=("pdf",)), ["pdf"]), (lambda v: v.sources(["web", "news"]), ["web", "news"]), (lambda v: v.sources(["maps"]), None),
        (lambda v: v.json_object('{"a": 1}', "schema"), {"a": 1}), (lambda v: v.json_object("[1]", "schema"), None), (lambda v: v.json_object("{", "schema"), None), (lambda v: v.text("x" * 20_000, "t"), None),
    ],
)
def test_validators(call, want):
    if want is not None:
        assert call(validators) == want
        return
    with pytest.raises(validators.Invalid):
        call(validators)


def test_absent_values():
    assert [validators.formats(None), validators.sources(None), validators.timeout(None), validators.limit(None), validators.json_object(None, "s"), validators.url(" ", optional=True), validators.prompt(None, optional=True)] == [None] * 7


def test_medians(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.random(), 0.5, 7.0])) for _ in range(5000)] + [("two", 1.0), ("two", 4.0), ("one", 9.0), ("none", None), (None, 2.0), (None, 6.0)]
    got = {r["k"]: r["median"] for r in medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", buckets=8).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == {"hot": (hot[2499] + hot[2500]) / 2, "two": 2.5, "one": 9.0, None: 4.0}


def test_running_values_by_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i // 50, i, rng.choice([None, rng.randrange(100)])) for i in range(600)]
    d = spark.createDataFrame(rows, "k string, b long, i long, v long").repartition(5)
    got = {r["i"]: r for r in running(d, "k", "b", ["i"], {"n": ("sum", F.col("v")), "m": ("max", F.col("v")), "s": ("max", F.when(F.col("v") > 90, F.struct("i", "v")))}).collect()}
    for k in ("a", "b", None):
        total, most, last = 0, None, None
        for _, _, i, v in (r for r in rows if r[0] == k):
            total += v or 0
            most = v if most is None else max(most, v if v is not None else most)
            last = (i, v) if v is not None and v > 90 else last
            assert (got[i]["n"], got[i]["m"], got[i]["s"] and tuple(got[i]["s"])) == (total, most, last)


def test_bursts_share_a_slot(spark):
    d = spark.createDataFrame([("h", 0.0, i) for i in range(7)], "host string, t double, seq long")
    got = [r["send_at"] for r in states.send_times(d, "host", "t", 10.0, burst=3).orderBy("seq").collect()]
    assert got == [0, 0, 0, 10, 10, 10, 20]


def test_streamed_cache_keeps_the_last_entry(spark, tmp_path):
    source, cache = f"{tmp_path}/in", f"{tmp_path}/cache"
    schema = "key string, ts long, seq long, body string"
    for n, rows in enumerate(([("a", 1, 1, "x"), ("b", 1, 2, "y")], [("a", 2, 3, "z")], [("c", 1, 4, "w"), ("a", 1, 5, "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        policies.upsert_cache(spark.readStream.schema(schema).parquet(source), cache, f"{tmp_path}/state").awaitTermination()
        held = {r["key"]: r["body"] for r in policies.cache_version(spark, cache).collect()}
        assert held == [{"a": "x", "b": "y"}, {"a": "z", "b": "y"}, {"a": "z", "b": "y", "c": "w"}][n]
    assert len(list((tmp_path / "cache/versions").glob("*.json"))) <= 2
    buckets = [p for p in (tmp_path / "cache/data").glob("v=*/_b=*")]
    assert len(buckets) == len({p.name for p in buckets}) + 1  # the last batch rewrote one bucket; the other is as it was


def test_yaml_of_suites():
    text = """---
name: demo   # a comment
description: >
  folded
  text
empty:
flow: [1, 'two', "a, b", true]
queries:
- id: q1
  query: "what: is"
  expect_domains:
    - a.org
    - 'it''s'
cases:
  - id: c1
    url: https://a.org/#x
    scored: false
    nested:
      deep: 1.5
  - plain
lit: |
  one
  two
"""
    assert readers.yaml(text) == {
        "name": "demo", "description": "folded text", "empty": None, "flow": [1, "two", "a, b", True],
        "queries": [{"id": "q1", "query": "what: is", "expect_domains": ["a.org", "it's"]}],
        "cases": [{"id": "c1", "url": "https://a.org/#x", "scored": False, "nested": {"deep": 1.5}}, "plain"], "lit": "one\ntwo",
    }
    assert readers.yaml("") is None and readers.yaml("- 1\n- a: 2\n  b: 3\n") == [1, {"a": 2, "b": 3}]


def test_settings_and_chains():
    assert readers.with_setting({"a": 1}, "b", 2) == {"a": 1, "b": 2} and readers.with_setting({"a": 1}, "a") == {}
    assert readers.shown({"api_key": "x", "mode": "y", "token": ""}) == {"api_key": "***", "mode": "y", "token": ""}
    with pytest.raises(KeyError):
        readers.with_setting({}, "z", 1, ["a"])
    assert search.chain_names("Brave, serper,brave", {"brave": "k"}) == ["brave", "duckduckgo"]
    assert search.chain_names(None, {"exa": "k", "tavily": "k"}) == ["tavily", "exa", "duckduckgo"]
    assert search.chain_names("duckduckgo", {}, strict=True) == ["duckduckgo"]
    with pytest.raises(ValueError):
        search.chain_names("brave", {}, strict=True)


def test_jpeg_and_webp_headers():
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xc2\x00\x11\x08\x00\x20\x01\x00"
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert images.header_size(jpeg) == (256, 32) and images.header_size(webp) == (100, 50)
    assert images.header_size(b"\xff\xd8\xff") is None and images.header_size(None) is None and images.header_size(b"BM") is None
