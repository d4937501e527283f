"""Site graphs: link traversal, robots rules, the filter chain before a crawl (STM-01..03, JOIN-01/02/05, PRD-22..25, SET-01/03, TOP-06, SNK-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import urls
from quern.scratch import materialize as step


def traverse(edges: DataFrame, start: DataFrame, depth: int = 3, limit: int | None = None) -> DataFrame:
    """(url, depth) of pages reached from ``start`` (url) over edges (src, dst) in at most ``depth`` steps, each once, nearest first.

    Each step joins the frontier with the edges and drops what was seen; lineage is cut
    by a written table.  With a limit the nearest pages count, by address within a depth.
    """
    edges = edges.select("src", "dst").distinct()
    seen = step(start.select("url", F.lit(0).alias("depth")).distinct(), "seen")
    front = seen
    for d in range(1, depth + 1):
        found = front.join(edges, front["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        front = step(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if limit is not None and seen.count() >= limit:
            break
    return seen if limit is None else seen.orderBy("depth", "url").limit(limit)


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as an anchored regular expression: ``*`` matches anything, a final ``$`` the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    quoted = F.replace(quoted, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), quoted, F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (url, origin) with ``allowed``: the longest matching rule of the origin decides, allow wins ties.

    ``rules``: origin, kind (allow or disallow), pattern.  Rules are grouped to one row
    an origin, so the join is an equality join and pages are not multiplied.
    """
    held = rules.groupBy("origin").agg(F.collect_list(F.struct("kind", F.char_length("pattern").alias("n"), pattern_regex(F.col("pattern")).alias("regex"))).alias("rules"))
    target = F.when(urls.path(F.col("url")) == "", F.lit("/")).otherwise(urls.path(F.col("url")))
    hits = F.filter("rules", lambda r: F.regexp_like(target, r["regex"]))
    longest = lambda kind: F.coalesce(F.array_max(F.transform(F.filter(hits, lambda r: r["kind"] == kind), lambda r: r["n"])), F.lit(-1))
    joined = pages.join(held, "origin", "left")
    return joined.withColumn("allowed", F.coalesce((longest("disallow") == -1) | (longest("allow") >= longest("disallow")), F.lit(True))).drop("rules")


def chosen(found: DataFrame, done: DataFrame | None = None, include: list[str] | None = None, exclude: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """URLs (url, seq) to crawl: resume, include, exclude, robots, first of equal addresses, in this order."""
    left = found
    if done is not None:
        left = left.join(done.select("url").distinct(), "url", "left_anti")
    if include:
        left = left.where(urls.matches_any(F.col("url"), include))
    if exclude:
        left = left.where(~urls.matches_any(F.col("url"), exclude))
    if rules is not None:
        left = robots_allowed(left.withColumn("origin", urls.origin(F.col("url"))), rules).where("allowed").drop("allowed", "origin")
    return left.groupBy(urls.dedupe_key(F.col("url")).alias("key")).agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq"))


def named_files(pages: DataFrame) -> DataFrame:
    """Pages (url, seq) with their file names; of equal slugs all but the first carry a hash of the address.

    The first of each slug is a grouped minimum, so no slug's pages meet in one task.
    """
    slugged = pages.withColumn("slug", urls.crawl_slug(F.col("url")))
    place = F.struct("seq", "url")
    first = slugged.groupBy(F.col("slug").alias("_slug")).agg(F.min(place).alias("_first"))
    named = slugged.join(first, F.col("slug").eqNullSafe(F.col("_slug")))
    return named.withColumn("name", F.when(place > F.col("_first"), F.concat("slug", F.lit("-"), urls.url_hash(F.col("url")))).otherwise(F.col("slug"))).drop("_slug", "_first")


def change_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy("change_status").agg(F.count("*").alias("n"))


def mapped(found: DataFrame, limit: int, search: str | None = None) -> DataFrame:
    """Of a map's addresses (url, seq) the first ``limit``, and of these those that hold the search text: in this order."""
    first = found.orderBy("seq", "url").limit(limit)
    return first if search is None else first.where(F.contains(F.lower("url"), F.lit(search.lower())))


def sitemap_pages(start: DataFrame, stored: DataFrame, rounds: int = 16) -> DataFrame:
    """Addresses (loc) of all pages that sitemaps lead to, from those of ``start`` (loc) on; ``stored`` has (loc, xml).

    Nested sitemaps are read round by round, each once, so indexes that name each other end.
    """
    from quern.sources.readers import sitemap

    seen = front = step(start.select("loc").distinct(), "sitemaps")
    pages = None
    for _ in range(rounds):
        found = step(sitemap(stored.join(front, "loc", "left_semi")), "listed")
        here = found.where("kind = 'page'").select("loc")
        pages = here if pages is None else pages.union(here)
        front = step(found.where("kind = 'sitemap'").select("loc").distinct().join(seen, "loc", "left_anti"), "sitemaps")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return pages.distinct()


def map_events(found: DataFrame, pages: DataFrame) -> DataFrame:
    """What a map reports, in order: sitemap, discovery, a row of metadata a page of an address, complete (step, url, title, n).

    Addresses found again do not multiply the pages that have them.
    """
    total = found.agg(F.count("*").alias("n"))
    titled = found.select("url").distinct().join(pages.select("url", "title"), "url", "left")
    return (
        total.select(F.lit(0).alias("step"), F.lit("sitemap").alias("event"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"), "n")
        .union(total.select(F.lit(1), F.lit("discovery"), F.lit(None), F.lit(None), "n"))
        .union(titled.select(F.lit(2), F.lit("metadata"), "url", "title", F.lit(None).cast("long")))
        .union(total.select(F.lit(3), F.lit("complete"), F.lit(None), F.lit(None), "n"))
    )


def crawl_events(pages: DataFrame) -> DataFrame:
    """What a crawl reports (step, event, url, done, total): mapping, then page or error with the progress, then complete.

    Pages have url, seq, success.  Progress is a running count by blocks of seq.
    """
    from quern.plans.running import running

    rows = pages.withColumns({"_all": F.lit(0), "_block": F.floor(F.col("seq") / 100_000)})
    rows = running(rows, "_all", "_block", ["seq"], {"done": ("sum", F.lit(1))})
    total = pages.agg(F.count("*").alias("total"), F.sum(F.col("success").cast("long")).alias("good"))
    each = rows.join(F.broadcast(total), how="cross").select(F.lit(1).alias("step"), F.when(F.col("success"), "page").otherwise("error").alias("event"), "url", F.col("done").cast("long").alias("done"), "total")
    ends = total.select(F.explode(F.array(F.struct(F.lit(0).alias("step"), F.lit("mapping").alias("event"), F.lit(0).cast("long").alias("done")), F.struct(F.lit(2).alias("step"), F.lit("complete").alias("event"), F.coalesce("good", F.lit(0)).alias("done")))).alias("e"), "total")
    return each.union(ends.select("e.step", "e.event", F.lit(None).cast("string"), "e.done", "total"))
