"""Benchmark reports as text, a row a run (SNK-07): one run, runs beside each other, one against another.

Every number is an aggregate of Spark's and every line an expression, so reports of any
number of runs come out of one pass; only a report's own few lines are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.running import medians

WORST = 5
TABLE_HEAD = "| Reader | Pages | Content kept | Boilerplate gone | Median s | Mean s | Tokens/page | Peak MB | Search |\n| --- | ---: | ---: | ---: | ---: | ---: | ---: | ---: | ---: |"


def _figure(value: Column, digits: int = 1) -> Column:
    """A number with so many digits, halves to even; n/a where there is none."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", F.bround(value, digits).cast("double")))


def _percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.concat(_figure(value * 100, 0), F.lit("%")))


def totals(cases: DataFrame) -> DataFrame:
    """A row a run of cases (run_id, category, success, scored, quality, latency_ms, expect_hit, expect_absent_ok, markdown_chars).

    Anchors and output count where the page came back; tokens are a quarter of the characters.
    """
    scored, good = F.when(F.col("scored"), F.col("quality")), lambda c: F.avg(F.when(F.col("success"), c))
    one = cases.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count(scored).alias("scored"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg(scored).alias("quality"), F.avg("latency_ms").alias("mean_ms"),
        good(F.col("expect_hit")).alias("kept"), good(F.col("expect_absent_ok")).alias("gone"), good(F.floor(F.col("markdown_chars") / 4)).alias("tokens"),
    )
    middle = medians(cases.select("run_id", "latency_ms"), ["run_id"], "latency_ms").withColumnRenamed("median", "median_ms")
    return one.join(middle, "run_id", "left")


def _lines(rows: DataFrame, by: str, order: list[Column], line: Column, name: str) -> DataFrame:
    """(by, name): lines of each run, in order."""
    held = F.sort_array(F.collect_list(F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)), line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias(name))


def run_reports(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, report) of runs (run_id, suite, reader, started, peak_mb): figures, categories, the worst scored cases."""
    scored = F.when(F.col("scored"), F.col("quality"))
    groups = cases.groupBy("run_id", "category").agg(F.count("*").alias("n"), F.count(scored).alias("s"), F.avg(scored).alias("q"), F.avg(F.col("success").cast("double")).alias("ok"))
    row = F.concat(F.lit("| "), F.coalesce("category", F.lit("")), F.lit(" | "), "n", F.lit(" | "), "s", F.lit(" | "), _figure(F.col("q")), F.lit(" | "), _percent(F.col("ok")), F.lit(" |"))
    categories = _lines(groups, "run_id", [F.coalesce("category", F.lit(""))], row, "categories")
    ranked = cases.where("scored and quality is not null").withColumn("r", F.row_number().over(Window.partitionBy("run_id").orderBy("quality", "case_id"))).where(F.col("r") <= WORST)
    case = F.concat(F.lit("- "), F.col("case_id").cast("string"), F.lit(": "), _figure(F.col("quality")), F.when(F.col("success"), "").otherwise(", failed"))
    worst = _lines(ranked, "run_id", [F.col("r")], case, "worst")
    t = runs.join(totals(cases), "run_id", "left").join(categories, "run_id", "left").join(worst, "run_id", "left")
    lines = [
        F.concat(F.lit("Run: "), "run_id"), F.concat(F.lit("Suite: "), F.coalesce("suite", F.lit("n/a")), F.lit("   Reader: "), F.coalesce("reader", F.lit("n/a"))), F.concat(F.lit("Started: "), F.coalesce(F.date_format("started", "yyyy-MM-dd HH:mm:ss"), F.lit("n/a"))),
        F.concat(F.lit("Overall quality: "), _figure(F.col("quality")), F.lit(" / 100")), F.concat(F.lit("Success rate: "), _figure(F.col("success_rate") * 100), F.lit("% ("), F.coalesce("n", F.lit(0)), F.lit(" cases, "), F.coalesce("scored", F.lit(0)), F.lit(" scored)")),
        F.concat(F.lit("Latency: median "), _figure(F.col("median_ms") / 1000), F.lit(" s, mean "), _figure(F.col("mean_ms") / 1000), F.lit(" s")), F.concat(F.lit("Content kept: "), _percent(F.col("kept")), F.lit("   Boilerplate gone: "), _percent(F.col("gone"))),
        F.concat(F.lit("Output: "), _figure(F.col("tokens"), 0), F.lit(" tokens per page")), F.concat(F.lit("Peak memory: "), _figure(F.col("peak_mb"), 0), F.lit(" MB")),
        F.lit("\n| Category | N | Scored | Quality | Success |\n| --- | ---: | ---: | ---: | ---: |"), F.col("categories"), F.when(F.col("worst").isNotNull(), F.concat(F.lit("\nWorst scored cases\n"), "worst")),
    ]
    return t.select("run_id", F.concat_ws("\n", *lines).alias("report"))


def table(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, row): each run (with reader, peak_mb, and searches and search_hit where it searched) as a row below ``TABLE_HEAD``."""
    t = runs.join(totals(cases), "run_id", "left")
    search = F.when(F.coalesce("searches", F.lit(0)) == 0, "none").when(F.col("search_hit").isNull(), "failed").otherwise(F.concat(_percent(F.col("search_hit")), F.lit(" of "), "searches"))
    cells = [
        F.coalesce("reader", F.lit("n/a")), F.concat(_percent(F.col("success_rate")), F.lit(" of "), F.coalesce("n", F.lit(0))), _percent(F.col("kept")), _percent(F.col("gone")), _figure(F.coalesce(F.col("median_ms"), F.lit(0.0)) / 1000),
        _figure(F.coalesce(F.col("mean_ms"), F.lit(0.0)) / 1000), _figure(F.coalesce("tokens", F.lit(0.0)), 0), _figure(F.coalesce(F.col("peak_mb").cast("double"), F.lit(0.0)), 0), search,
    ]
    return t.select("run_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def comparisons(compared: DataFrame, by: str) -> DataFrame:
    """(by, report) of cases compared (``quern.plans.benchmark.compare`` and a key): who got worse or better by 5, who newly fails."""

    def part(flag: str, title: str, order: Column, with_delta: bool) -> DataFrame:
        said = F.concat(F.lit("  "), F.col("case_id").cast("string"), F.concat(F.lit(" ("), F.format_string("%+.1f", "delta"), F.lit(")")) if with_delta else F.lit(""))
        rows = _lines(compared.where(flag), by, [order, F.col("case_id")], said, "lines")
        return rows.select(by, F.concat(F.lit(f"{title}:\n"), "lines").alias(flag))

    every = compared.groupBy(by).agg(F.avg("delta").alias("d"))
    for flag, title, order, told in (("regression", "Regressions", F.col("delta"), True), ("improvement", "Improvements", F.negative("delta"), True), ("newly_failing", "Newly failing", F.lit(0), False)):
        every = every.join(part(flag, title, order, told), by, "left")
    mean = F.concat(F.lit("Mean change of quality: "), F.when(F.col("d").isNull(), "n/a").otherwise(F.format_string("%+.1f", F.bround("d", 1))))
    none = F.when(F.coalesce("regression", "improvement", "newly_failing").isNull(), "No significant changes.")
    return every.select(by, F.concat_ws("\n", mean, "regression", "improvement", "newly_failing", none).alias("report"))
