import datetime as dt
import random

from pyspark.sql import functions as F

from quern.plans import benchmark, crawl, states, telemetry
from quern.sources import readers, writers
from quern.streaming import policies

OBS = "domain string, engine string, stealth boolean, wait_for int, only_main_content boolean, verdict string, score int, ts timestamp, seq long"


def observations(n=300):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    return [(rng.choice(["a", "b", "c", "d"]), rng.choice([None, "playwright", "camoufox"]), rng.random() < 0.5, 0, True, rng.choice(["ok", "ok", "ok", "bot_challenge", "thin"]), rng.randrange(20, 100), t0 + dt.timedelta(minutes=i), i) for i in range(n)]


def folded(rows):
    out = {}
    for r in rows:
        seen = dict(zip(["domain", "engine", "stealth", "wait_for", "only_main_content", "verdict", "score", "ts", "seq"], r, strict=True))
        out[r[0]] = states.champion_step(out.get(r[0]), seen)
    return {k: (v["engine"], v["stealth"], round(v["ewma_score"], 9), v["samples"]) for k, v in out.items() if v}


def test_champion_rules():
    base = {"engine": "camoufox", "stealth": False, "wait_for": 0, "only_main_content": True, "verdict": "ok", "score": 80, "ts": None}
    c = states.champion_step(None, base)
    assert states.champion_step(c, base | {"verdict": "captcha"}) is None
    assert states.champion_step(c, base | {"verdict": "captcha", "engine": None}) == c
    assert states.champion_step(c, base | {"engine": None, "score": 75})["engine"] is None
    assert states.champion_step(c, base | {"engine": None, "score": 74}) == c
    assert states.champion_step(c, base | {"score": 60})["ewma_score"] == 70
    assert states.champion_step(None, base | {"score": 39}) is None


def test_champions_batch(spark):
    rows = observations()
    got = {r["domain"]: (r["engine"], r["stealth"], round(r["ewma_score"], 9), r["samples"]) for r in states.champions(spark.createDataFrame(rows, OBS)).collect()}
    assert got == folded(rows)


def test_champions_stream_equals_batch(spark, tmp_path):
    rows = observations(60)
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * (k + 1)], OBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    seen = []
    q = policies.champion_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["domain"]: (r["engine"], r["stealth"], round(r["ewma_score"], 9), r["samples"]) for r in seen}
    want = folded(rows)
    assert {k: v for k, v in last.items() if k in want} == want


def test_hourly_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), m % 2 == 0) for h in range(3) for m in range(0, 60, 10)]
    spark.createDataFrame(rows, "ts timestamp, success boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, success boolean").parquet(str(tmp_path / "in"))
    q = policies.hourly_success(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["n"] for r in spark.table("hourly").orderBy("start").collect()] == [6, 6, 6]


def test_ewma_matches_fold(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), i, i, rng.random() * 10) for i in range(200)]
    want = {}
    for k, _, _, v in rows:
        want[k] = v if k not in want else 0.5 * v + 0.5 * want[k]
    got = telemetry.ewma(spark.createDataFrame(rows, "k string, ts long, seq long, v double"), "k", "v").collect()
    assert all(abs(r["ewma"] - want[r["k"]]) < 1e-9 for r in got)


def test_throttle_matches_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(100)), i) for i in range(80)]
    last, want = {}, {}
    for h, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        last[h] = max(t, last[h] + 3.0) if h in last else t
        want[i] = last[h]
    got = states.send_times(spark.createDataFrame(rows, "h string, t double, seq long"), "h", "t", 3.0)
    assert {r["seq"]: r["send_at"] for r in got.collect()} == want


def test_breaker_matches_machine(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, i, rng.choice(["fail", "fail", "empty", "ok"])) for i in range(200)]
    state, want = {}, {}
    for p, _, i, kind in rows:
        f, e, s = state.get(p, (0, 0, "healthy"))
        if kind == "fail":
            f, s = f + 1, "unavailable" if f + 1 >= 3 else "degraded"
        elif kind == "empty":
            f, e = 0, e + 1
            s = "degraded" if e >= 3 or s == "unavailable" else s
        else:
            f, e, s = 0, 0, "healthy"
        state[p] = (f, e, s)
        want[i] = state[p]
    got = states.breaker(spark.createDataFrame(rows, "p string, ts long, seq long, k string"), "p", F.col("k") == "fail", F.col("k") == "empty")
    assert {r["seq"]: (r["consecutive_failures"], r["consecutive_empty"], r["status"]) for r in got.collect()} == want


def test_alerts(spark):
    rows = [("a", float(t), t) for t in (0, 100, 299, 300, 500, 600, 900)] + [("b", 5.0, 1)]
    got = sorted((r["k"], r["t"]) for r in states.alerts(spark.createDataFrame(rows, "k string, t double, seq long"), "k").collect())
    assert got == [("a", 0.0), ("a", 300.0), ("a", 600.0), ("a", 900.0), ("b", 5.0)]


def test_provider_chain(spark):
    rows = [(1, 0, "a", 0, "fallback"), (1, 1, "b", 0, None), (1, 2, "c", 3, None), (2, 0, "a", 0, "fatal"), (2, 1, "b", 5, None), (3, 0, "a", 0, None), (3, 1, "b", 0, "fatal"), (4, 0, "a", 0, "fallback")]
    got = {r["request"]: (r["provider"], r["outcome"]) for r in states.provider_chain(spark.createDataFrame(rows, "request int, priority int, provider string, n_results int, error_class string")).collect()}
    assert got == {1: ("c", "answered"), 2: (None, "failed"), 3: (None, "empty"), 4: (None, "exhausted")}


def test_token_overlap(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "c", "c"]), (2, [], ["a"]), (3, ["x"], ["y"])], "k int, e array<string>, g array<string>")
    got = {r["k"]: (r["precision"], r["recall"], r["f1"]) for r in benchmark.token_overlap(df, "k", "e", "g").collect()}
    assert got[1] == (2 / 3, 0.5, 2 * (2 / 3) * 0.5 / (2 / 3 + 0.5)) and got[2] == got[3] == (0.0, 0.0, 0.0)


def test_traverse(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a"), ("a", "c")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {r["url"]: r["depth"] for r in crawl.traverse(edges, start, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert [r["url"] for r in crawl.traverse(edges, start, 3, 2).collect()] == ["a", "b"]


def test_robots(spark):
    rules = spark.createDataFrame([("https://a.org", "disallow", "/x"), ("https://a.org", "allow", "/x/y"), ("https://a.org", "disallow", "/*.gif$")], "origin string, kind string, pattern string")
    pages = spark.createDataFrame([(u, "https://a.org") for u in ("https://a.org/x", "https://a.org/x/y/z", "https://a.org/i.gif", "https://a.org/i.gif?q", "https://a.org/i.gifs", "https://a.org")] + [("https://b.org/x", "https://b.org")], "url string, origin string")
    got = {r["url"]: r["allowed"] for r in crawl.robots_allowed(pages, rules).collect()}
    assert got == {"https://a.org/x": False, "https://a.org/x/y/z": True, "https://a.org/i.gif": False, "https://a.org/i.gif?q": False, "https://a.org/i.gifs": True, "https://a.org": True, "https://b.org/x": True}


def test_chosen(spark):
    found = spark.createDataFrame([("https://a.org/1", 1), ("https://a.org/1#x", 2), ("https://a.org/2", 3), ("https://a.org/no", 4)], "url string, seq int")
    done = spark.createDataFrame([("https://a.org/2",)], "url string")
    assert [r["url"] for r in crawl.chosen(found, done, exclude=["/no$"]).collect()] == ["https://a.org/1"]


def test_sources_and_sinks(spark, tmp_path):
    xml = spark.createDataFrame([("<urlset><url><loc>https://a.org/1?x=1&amp;y</loc></url></urlset>",), ("<sitemapindex><sitemap><loc>s.xml</loc></sitemap></sitemapindex>",)], "xml string")
    assert {(r["loc"], r["kind"]) for r in readers.sitemap(xml).collect()} == {("https://a.org/1?x=1&y", "page"), ("s.xml", "sitemap")}
    (tmp_path / "u.txt").write_text("# c\n\n https://a.org \n")
    assert [r["url"] for r in readers.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://a.org"]
    pages = spark.createDataFrame([("https://a.org/p", 'T "q"', "body", 1), ("https://b.org/p", None, "b2", 2)], "url string, title string, markdown string, seq int")
    files = {r["name"]: r["content"] for r in writers.page_files(pages).collect()}
    assert files["p.md"] == '---\nsource_url: "https://a.org/p"\ntitle: "T \\"q\\""\n---\n\nbody' and len(files) == 2
    writers.write_manifest(pages, str(tmp_path / "m"))
    assert readers.manifest(spark, str(tmp_path / "m")).count() == 2
    stored = spark.createDataFrame([(1, "https://a.org/p?utm_source=x", "<p>")], readers.PAGE)
    got = {r["url"]: r["status"] for r in readers.replay(pages, stored).collect()}
    assert got == {"https://a.org/p": 200, "https://b.org/p": 404}
    (tmp_path / "log.jsonl").write_text('{"kind": "scrape", "ts": "2024-01-02T00:00:00", "success": true}\n{bad\n{"kind": "search"}\n')
    assert telemetry.read_log(spark, str(tmp_path / "log.jsonl"), kind="scrape", since="2024-01-02").count() == 1
    assert "| n |" in writers.report(spark.range(1).selectExpr("id as n"))


def test_latest_and_seeds(spark):
    e = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, ts int, v string")
    assert states.latest(e, "key", ["ts"]).first()["v"] == "b"
    known = spark.createDataFrame([("d", "camoufox", True, 5, True, 90.0, 2, "ok", dt.datetime(2024, 1, 10)), ("old", None, True, 5, True, 90.0, 2, "ok", dt.datetime(2023, 1, 10))], states.CHAMPION)
    got = {r["domain"]: r["engine"] for r in states.seeds(spark.createDataFrame([("d",), ("old",), ("new",)], "domain string"), known, F.lit("2024-01-11").cast("timestamp"), 0.0).collect()}
    assert got == {"d": "camoufox", "old": None, "new": None}
