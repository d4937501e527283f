"""Event logs: scans, summaries, windows, pruning (SRC-10, SNK-04, AGG-01, WIN-01/04, TOP-02/03/07/12, DT-06).

Events have columns ts, kind, domain, verdict, success, escalated, seq (a total order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.running import running

SCRAPE = "schema int, kind string, ts string, domain string, success boolean, verdict string, score int, attempts int, escalated boolean, word_count int, status_code int, cache_hit boolean, latency_ms double, url string"
SEARCH = "schema int, kind string, ts string, provider string, result_count int, success boolean, latency_ms double, query_hash string, query string"


def read_log(spark: SparkSession, path: str, schema: str = SCRAPE, kind: str | None = None, since: str | None = None) -> DataFrame:
    """Events of a JSON-lines log; lines that do not parse are skipped; ``since`` is inclusive."""
    events = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    events = events.where(F.col("kind") == kind) if kind else events.where("kind is not null")
    return events.where(F.col("ts").try_cast("timestamp") >= F.lit(since).cast("timestamp")) if since else events


def append_log(events: DataFrame, path: str) -> None:
    """Add events to a log; a query text is kept as a hash of 12 digits only."""
    if "query" in events.columns:
        events = events.withColumn("query_hash", F.substring(F.sha2("query", 256), 1, 12)).drop("query")
    events.write.mode("append").json(path)


def summary(events: DataFrame) -> DataFrame:
    """One row: number of events, success and escalation rates (null without events)."""
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return events.agg(F.count("*").alias("scrapes"), rate("success").alias("success_rate"), rate("escalated").alias("escalation_rate"))


def by_verdict(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("verdict", F.lit("unknown")).alias("verdict")).agg(F.count("*").alias("n"))


def top_domains(events: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` domains with most events; ties by name."""
    return events.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(n)


def since(events: DataFrame, cutoff: str) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz"))


def prune(events: DataFrame, cutoff: str | None = None, keep_last: int | None = None) -> DataFrame:
    """Events from the cutoff on, of these the last ``keep_last`` (a bounded top-k)."""
    if cutoff:
        events = since(events, cutoff)
    return events if keep_last is None else events.orderBy(F.desc("ts"), F.desc("seq")).limit(keep_last)


def recent_empty(events: DataFrame, by: str, empty: Column, n: int = 5, width: str = "day") -> DataFrame:
    """Events of each source with whether its last ``n`` (this one among them) were all empty: a run of ``n`` or more.

    Histories are split by ``width`` of ts.
    """
    rows = events.withColumns({"_block": F.date_trunc(width, F.col("ts").cast("timestamp")), "_e": F.coalesce(empty, F.lit(False))})
    order = ["ts", "seq"]
    rows = running(rows, by, "_block", order, {"_i": ("sum", F.lit(1))})
    rows = running(rows, by, "_block", order, {"_full": ("max", F.when(~F.col("_e"), F.col("_i")))})
    return rows.withColumn("all_empty", F.col("_i") - F.coalesce("_full", F.lit(0)) >= n).select(*events.columns, "all_empty")


def ewma(events: DataFrame, by: str, value: str, alpha: float = 0.5, width: str = "day") -> DataFrame:
    """Last exponentially weighted mean of each key, in order of ts and seq.

    With weights alpha (1 - alpha)^age the mean is a plain weighted sum.  Ages are counted within blocks of ``width``
    of ts; a block's sum then weighs less by the rows of all later blocks, so a key's history is shared out.
    """
    rows = events.withColumn("_block", F.date_trunc(width, F.col("ts").cast("timestamp")))
    at = Window.partitionBy(by, "_block").orderBy(F.desc("ts"), F.desc("seq"))
    aged = rows.withColumn("_age", F.row_number().over(at) - 1)
    decay = lambda age: F.pow(F.lit(1 - alpha), age)
    blocks = aged.groupBy(by, "_block").agg(F.sum(alpha * decay(F.col("_age")) * F.col(value)).alias("_s"), F.count("*").alias("_n"), F.max_by(value, "_age").alias("_first"))
    later = Window.partitionBy(by).orderBy(F.desc("_block"))
    blocks = blocks.withColumns({"_after": F.sum("_n").over(later) - F.col("_n"), "_oldest": F.row_number().over(Window.partitionBy(by).orderBy("_block")) == 1})
    # the first value of all weighs (1 - alpha)^age, without alpha
    start = F.when(F.col("_oldest"), (1 - alpha) * decay(F.col("_n") - 1) * F.col("_first")).otherwise(0.0)
    return blocks.groupBy(by).agg(F.sum((F.col("_s") + start) * decay(F.col("_after"))).alias("ewma"), F.sum("_n").alias("samples"))


def windowed_success(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Success rate by tumbling windows; for a stream set a watermark on ts before."""
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate")).select(F.col("w.start").alias("start"), "n", "success_rate")
