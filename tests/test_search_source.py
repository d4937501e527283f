"""Search as a data source: requests, replies, filters and the chain."""

import json
from datetime import date

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringStartsWith

from quern.sources import search_source
from quern.sources.search_source import SearchReader, Searches, Wanted, request, results


def reader(**options):
    return SearchReader({"chain": "brave,exa", "searches": "file:///none"} | options)


def test_filters_become_parameters_and_all_but_the_kind_stay_with_spark():
    r = reader()
    given = [EqualTo(("kind",), "news"), In(("site",), ("b.org", "a.org")), GreaterThanOrEqual(("published",), date(2024, 1, 2)), LessThan(("published",), date(2024, 2, 1)), LessThanOrEqual(("i",), 3), StringStartsWith(("title",), "x")]
    assert list(r.pushFilters(given)) == given[1:]
    assert r.wanted == Wanted(["news"], 4, ["a.org", "b.org"], date(2024, 1, 2), date(2024, 1, 31))
    assert request("brave", "news", " q ", r.wanted) == {"place": "https://api.search.brave.com/res/v1/news/search", "parameters": {"q": "q (site:a.org OR site:b.org)", "count": 4, "freshness": "2024-01-02to2024-01-31"}}
    assert request("serper", "web", "q", r.wanted)["parameters"] == {"q": "q (site:a.org OR site:b.org)", "num": 4, "tbs": "cdr:1,cd_min:1/2/2024,cd_max:1/31/2024"}
    assert request("exa", "news", "q", r.wanted)["parameters"] == {"query": "q", "numResults": 4, "category": "news", "includeDomains": ["a.org", "b.org"], "startPublishedDate": "2024-01-02T00:00:00.000Z", "endPublishedDate": "2024-01-31T00:00:00.000Z"}
    assert request("tavily", "web", "q", Wanted(since=date(2024, 1, 2)))["parameters"] == {"query": "q", "max_results": 10, "topic": "general", "start_date": "2024-01-02"}


def test_images_know_no_filters_and_half_a_time_is_not_sent():
    w = Wanted(sites=["a.org"], since=date(2024, 1, 2), until=date(2024, 1, 3))
    assert request("serpapi", "images", "q", w)["parameters"] == {"engine": "google_images", "q": "q", "num": "10"}
    assert "freshness" not in request("brave", "web", "q", Wanted(since=date(2024, 1, 2)))["parameters"]
    assert request("searxng", "news", "q", w, "https://s.example/")["place"] == "https://s.example/search"


@pytest.mark.parametrize("body", ["", "null", "[1]", '{"results": null}', '{"results": {"a": 1}}', '{"results": [null, 3, {"title": "no address"}, {"url": ""}]}'])
def test_odd_replies_have_no_results(body):
    assert results("exa", "web", body, 10) == []


def test_first_field_that_is_there_and_sizes():
    body = json.dumps({"results": [{"url": "https://A.org/x", "img_src": "i", "source": "s", "resolution": "640 x 480"}]})
    (row,) = results("searxng", "images", body, 5)
    assert (row["description"], row["thumbnail"], row["image_width"], row["image_height"], row["site"]) == ("s", "i", 640, 480, "a.org")


CASES = {
    "spent": ([(429, "")], "exa", 1), "refused key": ([(403, "Invalid key")], "exa", 1), "plain refusal": ([(400, "bad query")], "brave answered 400", 0),
    "timeout": ([TimeoutError("slow")], "exa", 1), "captcha": ([ValueError("CAPTCHA shown")], "exa", 1), "fault": ([ValueError("no host")], "no host", 0),
    "empty, then a fault": ([(200, "{}"), ValueError("no host")], None, 0), "all spent": ([(402, ""), (429, "")], "exa answered 429", 0), "server": ([(500, "")], "brave answered 500", 0),
}


@pytest.mark.parametrize("name", CASES)
def test_chain(name):
    replies, who, n = CASES[name]
    turn = iter([*replies, (200, json.dumps({"results": [{"url": "https://a.org"}]}))])

    def send(search, provider, kind, asked):
        x = next(turn)
        if isinstance(x, Exception):
            raise x
        return x[0], {"X-RateLimit-Remaining": "7"}, x[1]

    r = reader()
    r._sender = lambda rows: send
    r.wanted.kinds = ["web"]
    rows = list(r.read(Searches([(1, "q")])))
    assert [x[2] if n else x[-1] for x in rows] == ([who] if who else [])


def test_unknown_provider_is_refused():
    with pytest.raises(ValueError, match="nobody"):
        reader(chain="brave,nobody")


def test_partitions_and_pushdown_in_spark(spark, tmp_path):
    searches, replies = f"file://{tmp_path}/s", f"file://{tmp_path}/r"
    spark.range(5).selectExpr("id AS search", "concat('q', id) AS query").write.parquet(searches)
    body = json.dumps({"results": [{"url": f"https://a.org/{k}", "publishedDate": f"2024-0{1 + k}-01"} for k in range(4)]})
    rows = [(k, "exa", kind, 200, None, body) for k in range(5) for kind in ("web", "news")]
    spark.createDataFrame(rows, "search long, provider string, kind string, status int, remaining string, body string").write.parquet(replies)
    search_source.register(spark)
    found = spark.read.format("quern_search").options(searches=searches, replies=replies, chain="exa").load()
    assert found.where("kind = 'web'").rdd.getNumPartitions() == 5
    assert found.where("kind = 'news' and published >= DATE'2024-02-01' and i < 3").groupBy("kind").count().collect() == [("news", 10)]
    assert found.where("site = 'b.org'").count() == 0
    assert found.where("provider is not null").count() == 40
