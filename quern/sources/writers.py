"""Sinks: crawled pages, batch results, reports (SNK-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.plans import crawl


def page_files(pages: DataFrame) -> DataFrame:
    """(name, content) of crawled pages (url, title, markdown, seq): front matter and markdown."""
    named = crawl.named_files(pages)
    front = text.frontmatter({"source_url": F.col("url"), "title": F.col("title")})
    return named.select(F.concat("name", F.lit(".md")).alias("name"), F.concat(front, F.lit("\n\n"), "markdown").alias("content"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Page files as a table of names and contents, so that any store will do."""
    page_files(pages).write.mode("append").parquet(path)


def write_manifest(pages: DataFrame, path: str) -> None:
    """Addresses done, in JSON, a file each task."""
    pages.groupBy(F.spark_partition_id().alias("part")).agg(F.collect_list("url").alias("scraped_urls")).drop("part").write.mode("append").json(path)


def batch_json(results: DataFrame) -> DataFrame:
    """Results as JSON lines."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def report(summary: DataFrame, limit: int = 100) -> str:
    """A small result as a markdown table; reports have a limit by nature."""
    rows = summary.limit(limit).collect()
    head = "| " + " | ".join(summary.columns) + " |"
    lines = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join([head, "|" + " --- |" * len(summary.columns), *lines])
