"""Search connectors as request columns, and a chain that runs them (SRC-14..20, UDF-04, JOIN-08, SET-02, MSC-16).

A provider's request is made by column expressions from a table of searches, so filters
become the provider's own parameters before anything is sent.  Sending is a callable
that the caller brings; replies come back as rows.

Searches: search, query, n, time_range, start_date, end_date (ISO dates), include, exclude (arrays of domains).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.scratch import materialize

# How providers spell a day, a week, a month, a year.
BRAVE = {"day": "pd", "week": "pw", "month": "pm", "year": "py"}
GOOGLE = {"day": "qdr:d", "week": "qdr:w", "month": "qdr:m", "year": "qdr:y"}
RESULT = "search long, i int, url string, title string, description string, source_type string, error string"


def _spelled(names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col("time_range") == k, v).otherwise(out)
    return out


def _with_sites() -> Column:
    return urls.site_query(F.trim("query"), F.col("include"), F.col("exclude"))


def _dates() -> Column:
    return F.col("start_date").isNotNull() & F.col("end_date").isNotNull()


def brave() -> Column:
    span = F.when(_dates(), F.concat("start_date", F.lit("to"), "end_date")).otherwise(_spelled(BRAVE))
    return F.struct(_with_sites().alias("q"), F.col("n").alias("count"), span.alias("freshness"))


def _tbs() -> Column:
    low, high = text.us_date(F.col("start_date")), text.us_date(F.col("end_date"))
    return F.when(_dates(), F.concat(F.lit("cdr:1,cd_min:"), low, F.lit(",cd_max:"), high)).otherwise(_spelled(GOOGLE))


def serper() -> Column:
    return F.struct(_with_sites().alias("q"), F.col("n").alias("num"), _tbs().alias("tbs"))


def serpapi() -> Column:
    return F.struct(F.lit("google").alias("engine"), _with_sites().alias("q"), F.col("n").alias("num"), _tbs().alias("tbs"))


def tavily() -> Column:
    return F.struct("query", F.col("n").alias("max_results"), F.lit("general").alias("topic"), "time_range", "start_date", "end_date", F.col("include").alias("include_domains"), F.col("exclude").alias("exclude_domains"))


def exa(today: Column) -> Column:
    start = F.coalesce("start_date", F.date_format(text.days_back(F.col("time_range"), today), "yyyy-MM-dd"))
    return F.struct("query", F.col("n").alias("numResults"), F.col("include").alias("includeDomains"), F.col("exclude").alias("excludeDomains"), text.iso_instant(start).alias("startPublishedDate"), text.iso_instant(F.col("end_date")).alias("endPublishedDate"))


def searxng() -> Column:
    """A week is not known there."""
    return F.struct(_with_sites().alias("q"), F.lit("json").alias("format"), F.lit("general").alias("categories"), F.when(F.col("time_range") != "week", F.col("time_range")).alias("time_range"))


def duckduckgo() -> Column:
    return F.struct(_with_sites().alias("q"), F.substring("time_range", 1, 1).alias("df"))


PROVIDERS: dict[str, Callable[[], Column]] = {"brave": brave, "tavily": tavily, "serper": serper, "serpapi": serpapi, "exa": lambda: exa(F.current_date()), "searxng": searxng, "duckduckgo": duckduckgo}


def requests(searches: DataFrame, provider: str) -> DataFrame:
    """(search, request): the provider's parameters as JSON, unset ones left out."""
    return searches.select("search", F.to_json(PROVIDERS[provider]()).alias("request"))


# Where a provider's reply holds its results, and the fields of address, title and description.
REPLIES = {
    "brave": ("$.web.results", "url", "title", "description"), "tavily": ("$.results", "url", "title", "content"), "serper": ("$.organic", "link", "title", "snippet"),
    "serpapi": ("$.organic_results", "link", "title", "snippet"), "exa": ("$.results", "url", "title", "text"), "searxng": ("$.results", "url", "title", "content"),
}


def parsed(reply: Column, provider: str, n: Column | None = None) -> Column:
    """Results (url, title, description) of a provider's JSON reply, at most ``n``; an empty array where it has none."""
    place, *fields = REPLIES[provider]
    rows = F.from_json(F.get_json_object(reply, place), "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")
    rows = F.coalesce(rows, F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"))
    out = F.transform(rows, lambda r: F.struct(*(r[f].alias(k) for f, k in zip(fields, ("url", "title", "description"), strict=True))))
    out = F.filter(out, lambda r: r["url"].isNotNull())
    return out if n is None else F.slice(out, F.lit(1), F.greatest(n, F.lit(0)))


def appended(by_source: dict[str, DataFrame]) -> DataFrame:
    """Results of several sources one after another, each with its source; repeats stay."""
    out = None
    for source, found in by_source.items():
        part = found.withColumn("source_type", F.lit(source))
        out = part if out is None else out.unionByName(part)
    return out


def chain_names(asked: str | None, keys: dict[str, str], strict: bool = False) -> list[str]:
    """Providers to ask in order: those named (comma-separated), else those with a key; the keyless one ends a chain that is not strict.

    A named provider that is unknown, or that has no key where it needs one, is left out; a strict chain refuses it.
    """
    keyless = ("duckduckgo", "searxng")
    named = list(dict.fromkeys(x.strip().lower() for x in (asked or "").split(",") if x.strip()))
    able = lambda name: name in PROVIDERS and (name == "duckduckgo" or bool(keys.get(name)))
    if strict and (bad := [x for x in named if not able(x)]):
        raise ValueError(f"cannot use {', '.join(bad)}")
    chain = [x for x in (named or [p for p in PROVIDERS if p not in keyless]) if able(x)]
    return chain if strict or "duckduckgo" in chain else [*chain, "duckduckgo"]


def answered(asked: DataFrame, send: Callable[[dict], list[dict]], source_type: str = "web") -> DataFrame:
    """Results of requests by the caller's ``send``; an exception becomes a row with its text."""

    def run(batches):
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            rows = []
            for search, request in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = send(json.loads(request))
                except Exception as e:  # noqa: BLE001  a provider's fault is data for the chain
                    rows.append((search, None, None, None, None, source_type, str(e)))
                    continue
                rows += [(search, i, x.get("url"), x.get("title"), x.get("description"), source_type, None) for i, x in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return asked.select("search", "request").mapInArrow(run, RESULT)


def chained(searches: DataFrame, senders: list[tuple[str, Callable[[dict], list[dict]]]]) -> DataFrame:
    """Results of the first provider, in order, that has any; later ones are asked only about searches still open.

    Each provider's answers are written before anything reads them, so none is asked again.
    """
    left, out = searches, None
    for name, send in senders:
        got = answered(requests(left, name), send).withColumn("provider", F.lit(name)).where("url is not null")
        got = materialize(got, "answers")
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select("search").distinct(), "search", "left_anti")
    return out


def with_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results beside what was read at their addresses; ``search`` and ``i`` say their order."""
    return results.join(pages.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left").drop("_url")


def distinct_results(results: DataFrame) -> DataFrame:
    """Each address once a search, at its first place."""
    order = Window.partitionBy("search", urls.dedupe_key(F.col("url"))).orderBy("i")
    return results.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
