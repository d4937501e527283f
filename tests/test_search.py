import json

from pyspark.sql import functions as F

from quern.functions import detect
from quern.sources import search

SCHEMA = "search long, query string, n int, time_range string, start_date string, end_date string, include array<string>, exclude array<string>"


def test_parameters(spark):
    rows = [(1, " q ", 5, "week", None, None, ["a.org", "b.org"], ["c.org"]), (2, "q", 3, None, "2024-01-05", "2024-02-09", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lambda p: {r["search"]: json.loads(r["request"]) for r in search.requests(df, p).collect()}
    assert got("brave") == {1: {"q": "q (site:a.org OR site:b.org) -site:c.org", "count": 5, "freshness": "pw"}, 2: {"q": "q", "count": 3, "freshness": "2024-01-05to2024-02-09"}}
    assert got("serper")[2]["tbs"] == "cdr:1,cd_min:1/5/2024,cd_max:2/9/2024" and got("serper")[1]["tbs"] == "qdr:w"
    assert got("exa")[2]["startPublishedDate"] == "2024-01-05T00:00:00.000Z"
    assert "time_range" not in got("searxng")[1] and got("tavily")[1]["time_range"] == "week"


def test_chain_falls_through(spark):
    df = spark.createDataFrame([(1, "x", 5, None, None, None, None, None), (2, "y", 5, None, None, None, None, None)], SCHEMA)

    def first(request):
        if request["q"] == "x":
            raise RuntimeError("quota")
        return [{"url": "https://a.org", "title": "A"}, {"url": "https://a.org#x"}]

    out = search.chained(df, [("brave", first), ("serper", lambda r: [{"url": f"https://s.org/{r['q']}"}])])
    assert {(r["search"], r["provider"], r["url"]) for r in search.distinct_results(out).collect()} == {(1, "serper", "https://s.org/x"), (2, "brave", "https://a.org")}


def test_platform_and_eligibility(spark):
    x = spark.range(1).select(detect.platform(F.lit("<div data-foleon>")).alias("p"), detect.http_first(F.array(F.lit("markdown")), F.lit(False), F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("string")).alias("h"), detect.memory_eligible(F.array(F.lit("pdf")), F.lit(False), F.lit(None).cast("string")).alias("m")).first()
    assert (x["p"], x["h"], x["m"]) == ("foleon", True, False)
