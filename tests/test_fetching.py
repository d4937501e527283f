"""Rounds of requests: nothing is asked twice, the first good candidate counts."""

from pyspark.sql import functions as F

from quern.plans import fetching

SCHEMA = "method string, url string, status int, kind string, body string"


def replay(spark, rows, log):
    stored = spark.createDataFrame(rows, SCHEMA)

    def ask(wanted):
        log.extend((r.method, r.url) for r in wanted.collect())
        return stored.join(wanted, ["method", "url"], "left_semi")

    return ask


def test_first_good_candidate(spark):
    log = []
    ask = replay(spark, [("GET", "a1", 404, None, "x"), ("GET", "a2", 200, None, "y"), ("GET", "b1", 200, None, "z"), ("GET", "b1", 200, None, "z")], log)
    rows = [("a", 0, "GET", "a1"), ("a", 1, "GET", "a2"), ("a", 2, "GET", "a3"), ("b", 0, "GET", "b1"), ("b", 1, "GET", "a2"), ("c", 0, "GET", "a1"), ("c", 1, "GET", "none"), ("d", 0, "GET", None)]
    found = fetching.first_good(spark.createDataFrame(rows, "key string, turn int, method string, url string"), ask, F.coalesce(F.col("status") == 200, F.lit(False)), 3)
    assert sorted((r.key, r.turn, r.body) for r in found.collect()) == [("a", 1, "y"), ("b", 0, "z")]
    assert len(log) == len(set(log)) and ("GET", "a3") not in log


def test_sitemaps_that_name_each_other(spark):
    log = []
    link = lambda tag, *at: "".join(f"<{tag}><loc> {a} </loc></{tag}>" for a in at)
    ask = replay(
        spark,
        [
            ("GET", "http://a/sitemap.xml", 200, None, link("sitemap", "http://a/1.xml", "http://a/sitemap.xml", "http://a/gone.xml") + link("url", "http://a/0")),
            ("GET", "http://a/1.xml", 200, None, link("sitemap", "http://a/2.xml") + link("url", "http://a/x?a=1&amp;b=2")), ("GET", "http://a/2.xml", 200, None, link("sitemap", "http://a/1.xml") + link("url", "http://a/0", "http://a/y")),
            ("GET", "http://b/sitemap.xml", 500, None, link("url", "http://b/0")), ("GET", "http://b/sitemap_index.xml", 200, None, link("sitemap", "http://a/2.xml")), ("GET", "http://c/sitemap.xml", 200, None, "no xml"),
        ],
        log,
    )
    origins = spark.createDataFrame([("http://a",), ("http://a",), ("http://b",), ("http://c",)], "origin string")
    got = sorted(map(tuple, fetching.site_addresses(origins, ask).collect()))
    assert got == [("http://a", "http://a/0"), ("http://a", "http://a/x?a=1&b=2"), ("http://a", "http://a/y"), ("http://b", "http://a/0"), ("http://b", "http://a/x?a=1&b=2"), ("http://b", "http://a/y")]
    assert len(log) == len(set(log))


def test_kinds_of_bodies(spark):
    log = []
    ask = replay(
        spark,
        [
            ("HEAD", "h", 200, "text/html", None), ("HEAD", "p", 200, " application/pdf ", None), ("HEAD", "o", 200, None, None), ("GET", "o", 200, None, "junk%PDF-1.4"),
            ("HEAD", "r", 403, "application/pdf", None), ("GET", "r", 200, None, None), ("HEAD", "e", 500, None, None), ("GET", "e", 500, None, "%PDF-"), ("GET", "l", 200, None, "x" * 1020 + "%PDF-1"),
        ],
        log,
    )
    rows = spark.createDataFrame([(x,) for x in ("h", "p", "o", "r", "e", "l", "http://x/a.pdf", None)], "url string").where("url is not null")
    got = {r.url: (r.pdf, r.by) for r in fetching.probed(rows, ask).collect()}
    assert got == {"h": (False, "type"), "p": (True, "type"), "o": (True, "bytes"), "r": (False, "bytes"), "e": (False, "nothing"), "l": (False, "bytes"), "http://x/a.pdf": (True, "name")}
    assert ("GET", "h") not in log and ("HEAD", "http://x/a.pdf") not in log


def test_robots_files(spark):
    ask = replay(spark, [("GET", "http://a/robots.txt", 200, None, None), ("GET", "http://b/robots.txt", 404, None, "Disallow: /")], [])
    got = {r.origin: r.text for r in fetching.robots_texts(spark.createDataFrame([("http://a",), ("http://b",), ("http://c",)], "origin string"), ask).collect()}
    assert got == {"http://a": "", "http://b": None, "http://c": None}
