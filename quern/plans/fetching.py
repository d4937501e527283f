"""Fetching with candidates: sitemaps, robots files and kinds of bodies (SRC-04, SRC-06, SRC-08).

Requests are rows (method, url); ``ask`` is a function of such a table that gives replies
(method, url, status, kind, body), by a replay or by the caller's own connector; a request
without a reply failed.  Work proceeds in rounds: each asks only what its keys still need
and what was not asked before, failures included, and is written before the next one
reads it, so no request is sent twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls
from quern.scratch import materialize
from quern.sources.readers import sitemap

Ask = Callable[[DataFrame], DataFrame]
REPLY = ["method", "url", "status", "kind", "body"]
#: How deep sitemaps may name others.
NESTED = 8


def asked(requests: DataFrame, ask: Ask, known: DataFrame | None = None) -> DataFrame:
    """Replies to distinct requests (method, url) beside those of ``known``; what failed has a null status and is known too."""
    new = requests.select("method", "url").where("url is not null").distinct()
    if known is not None:
        new = new.join(known.select("method", "url"), ["method", "url"], "left_anti")
    new = materialize(new, "requests")
    got = new.join(ask(new).select(*REPLY).dropDuplicates(["method", "url"]), ["method", "url"], "left").select(*REPLY)
    got = materialize(got, "answers")
    return got if known is None else known.unionByName(got)


def first_good(candidates: DataFrame, ask: Ask, good: Column, turns: int) -> DataFrame:
    """(key, turn, method, url, status, kind, body) of each key's first candidate (key, turn, method, url) whose reply is ``good``.

    A later candidate is asked for only where all before it were not; keys without a good reply are absent.
    """
    known, done = None, None
    left = candidates
    for turn in range(turns):
        here = left.where(F.col("turn") == turn)
        known = asked(here, ask, known)
        found = materialize(here.join(known, ["method", "url"]).where(good).select("key", "turn", *REPLY), "good")
        done = found if done is None else done.unionByName(found)
        left = left.join(found.select("key").distinct(), "key", "left_anti")
    return done


def site_addresses(origins: DataFrame, ask: Ask) -> DataFrame:
    """(origin, url): what the sitemaps of each origin list, nested ones too, each once; origins without any are absent.

    Both usual places are read; a sitemap that names one already read, itself perhaps, leads nowhere.
    """
    places = F.explode(F.array(*(F.concat("origin", F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml"))))
    front = materialize(origins.select("origin", places.alias("url")).distinct(), "sitemaps")
    known, seen, pages = None, front, None
    for _ in range(NESTED):
        known = asked(front.withColumn("method", F.lit("GET")), ask, known)
        texts = front.join(known.where("method = 'GET' and status = 200 and body is not null").select("url", F.col("body").alias("xml")), "url")
        listed = sitemap(texts, "origin")
        listed = materialize(listed.distinct(), "listed")
        part = listed.where("kind = 'page'").select("origin", F.col("loc").alias("url"))
        pages = part if pages is None else pages.union(part)
        front = materialize(listed.where("kind = 'sitemap'").select("origin", F.col("loc").alias("url")).join(seen, ["origin", "url"], "left_anti"), "sitemaps")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return pages.distinct()


def robots_texts(origins: DataFrame, ask: Ask) -> DataFrame:
    """(origin, status, text) of each origin's robots file; text is null unless the reply was 200, so all is allowed then."""
    at = origins.select("origin").distinct().withColumn("url", F.concat("origin", F.lit("/robots.txt")))
    got = asked(at.withColumn("method", F.lit("GET")), ask)
    return at.join(got.drop("method"), "url").select("origin", "status", F.when(F.col("status") == 200, F.coalesce("body", F.lit(""))).alias("text"))


def probed(addresses: DataFrame, ask: Ask) -> DataFrame:
    """(url, pdf, by) of addresses: by their name, else by the type that a HEAD tells, else by the first bytes of a GET.

    The type settles it unless it is absent or says nothing of the content; what cannot be fetched is no PDF.
    """
    each = addresses.select("url").distinct()
    named = each.where(urls.is_pdf(F.col("url"))).select("url", F.lit(True).alias("pdf"), F.lit("name").alias("by"))
    open_ = each.where(~urls.is_pdf(F.col("url")))
    turns = F.posexplode(F.array(F.lit("HEAD"), F.lit("GET"))).alias("turn", "method")
    telling = ~F.coalesce(F.lower(F.split("kind", ";")[0]), F.lit("")).isin("", "application/octet-stream", "binary/octet-stream")
    good = F.coalesce(F.col("status") == 200, F.lit(False)) & ((F.col("method") == "GET") | telling)
    found = first_good(open_.select(F.col("url").alias("key"), "url", turns), ask, good, 2)
    by_type = F.lower(F.trim(F.split("kind", ";")[0])) == "application/pdf"
    body = F.locate("%PDF-", F.substring(F.coalesce("body", F.lit("")), 1, 1024)) > 0
    judged = found.select("url", F.when(F.col("method") == "HEAD", by_type).otherwise(body).alias("pdf"), F.when(F.col("method") == "HEAD", "type").otherwise("bytes").alias("by"))
    rest = open_.join(judged.select("url"), "url", "left_anti").select("url", F.lit(False).alias("pdf"), F.lit("nothing").alias("by"))
    return named.union(judged).union(rest)
