"""Benchmark runs: case metrics, rollups, comparison (AGG-02..04, AGG-08, AGG-10, JOIN-04, TOP-01, WIN-02, SNK-05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.running import medians


def token_overlap(pairs: DataFrame, key: str, extracted: str, gold: str) -> DataFrame:
    """Precision, recall and F1 of token arrays as multisets, per key.

    Tokens of both sides are counted in one grouped pass, so no pair of arrays meets in a join.
    """
    sides = pairs.select(key, F.explode(extracted).alias("token"), F.lit(1).alias("e"), F.lit(0).alias("g")).union(pairs.select(key, F.explode(gold).alias("token"), F.lit(0).alias("e"), F.lit(1).alias("g")))
    counts = sides.groupBy(key, "token").agg(F.sum("e").alias("e"), F.sum("g").alias("g"))
    totals = counts.groupBy(key).agg(F.sum(F.least("e", "g")).alias("both"), F.sum("e").alias("ne"), F.sum("g").alias("ng"))
    p, r = F.col("both") / F.col("ne"), F.col("both") / F.col("ng")
    some = (F.col("both") > 0) & (F.col("ne") > 0) & (F.col("ng") > 0)
    scored = totals.select(key, F.when(some, p).otherwise(0.0).alias("precision"), F.when(some, r).otherwise(0.0).alias("recall"), F.when(some, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    return pairs.select(key).join(scored, key, "left").select(key, *zero)


def reference_degenerate(markdown_words, reference_words):
    """A reference under 50 words of which the scrape has over three times as many."""
    return F.coalesce((reference_words < 50) & (markdown_words > reference_words * 3.0), F.lit(False))


def aggregate(cases: DataFrame) -> DataFrame:
    """One row of a run: rates, latency (mean, exact median), quality over scored cases, anchors over succeeded ones."""
    scored = F.when(F.col("scored"), F.col("quality"))
    good = lambda c: F.avg(F.when(F.col("success"), F.col(c)))
    one = cases.agg(
        F.count("*").alias("total_cases"), F.count(scored).alias("scored_cases"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.avg(scored).alias("overall_quality"), good("expect_hit").alias("expect_hit"), good("expect_absent_ok").alias("expect_absent_ok"),
    )
    middle = medians(cases.select(F.lit(0).alias("_g"), "latency_ms"), ["_g"], "latency_ms").select(F.col("median").alias("median_latency_ms"))
    return one.join(F.broadcast(middle), how="left")  # one row each


def by_category(cases: DataFrame) -> DataFrame:
    """Cases, scored cases, quality and success per category, and for all (null category)."""
    scored = F.when(F.col("scored"), F.col("quality"))
    return cases.rollup("category").agg(F.count("*").alias("n"), F.count(scored).alias("scored"), F.avg(scored).alias("quality"), F.avg(F.col("success").cast("double")).alias("success_rate"))


def worst(cases: DataFrame, n: int = 5) -> DataFrame:
    return cases.where("scored and quality is not null").orderBy("quality", "case_id").limit(n)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per case of the new run: change of quality, whether it got worse or better by 5, whether it newly fails."""
    held = old.select("case_id", F.col("quality").alias("old_quality"), F.col("success").alias("old_success"))
    delta = F.bround(F.col("quality") - F.col("old_quality"), 1)
    joined = new.join(held, "case_id", "left").withColumn("delta", delta)
    return joined.select("case_id", "delta", F.coalesce(F.col("delta") <= -5, F.lit(False)).alias("regression"), F.coalesce(F.col("delta") >= 5, F.lit(False)).alias("improvement"), F.coalesce(F.col("old_success") & ~F.col("success"), F.lit(False)).alias("newly_failing"))


def latest_runs(runs: DataFrame, n: int = 1) -> DataFrame:
    """The newest ``n`` runs of each provider, by run id."""
    order = Window.partitionBy("provider").orderBy(F.desc("run_id"))
    return runs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def write_run(cases: DataFrame, path: str, run_id: str) -> None:
    """Tidy case rows and one row of totals, a partition each run."""
    cases.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/cases")
    aggregate(cases).withColumn("run_id", F.lit(run_id)).write.mode("append").json(f"{path}/runs")


def search_aggregate(searches: DataFrame) -> DataFrame:
    """One row of a run's searches (success, expect_hit): how many, the share answered, and of these the share with an expected domain."""
    judged = F.when(F.col("success") & F.col("expect_hit").isNotNull(), F.col("expect_hit").cast("double"))
    return searches.agg(F.count("*").alias("search_queries"), F.avg(F.col("success").cast("double")).alias("search_success_rate"), F.avg(judged).alias("search_expect_hit"))


def selected_cases(cases: DataFrame, only: list[str] | None) -> DataFrame:
    """Cases whose id or category is named, in any case; all without names."""
    wanted = [x.lower() for x in only or []]
    return cases.where(F.lower(F.col("case_id").cast("string")).isin(wanted) | F.lower("category").isin(wanted)) if wanted else cases


def captured_cases(cases: DataFrame, outputs: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases with what the reader returned and the gold text, where it was captured without an error."""
    held = gold.where("error is null").select("case_id", "gold_text")
    return cases.join(outputs, "case_id", "left").join(held, "case_id", "left")


def peak(samples: DataFrame, by: str, value: str) -> DataFrame:
    """The largest sample of each run."""
    return samples.groupBy(by).agg(F.max(value).alias("peak"))


def run_label(provider: Column, version: Column, started: Column) -> Column:
    """A run's id: when it began, who ran and in which version."""
    return F.concat_ws("-", F.date_format(started, "yyyyMMdd'T'HHmmss"), provider, version)


def write_artifacts(results: DataFrame, path: str) -> None:
    """Markdown, gold text and metrics of each case, a partition a run."""
    results.write.mode("append").partitionBy("run_id").parquet(f"{path}/artifacts")


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_reader(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    """Add a reader under test: from cases (case_id, url) to outputs (case_id, markdown, success, latency_ms)."""
    READERS[name] = reader


def read_cases(name: str, cases: DataFrame) -> DataFrame:
    return READERS[name](cases)


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Case rows of a written run, of the newest one by default."""
    cases = spark.read.parquet(f"{path}/cases")
    if run_id is None:
        run_id = cases.agg(F.max(F.col("run_id").cast("string"))).first()[0]
    return cases.where(F.col("run_id") == run_id)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Totals of all written runs, newest first."""
    return spark.read.json(f"{path}/runs").orderBy(F.desc("run_id"))
