"""Report texts."""

from quern.plans import benchmark, reports

CASES = "run_id string, case_id int, category string, success boolean, scored boolean, quality double, latency_ms double, expect_hit double, expect_absent_ok double, markdown_chars int"


def test_table(spark):
    cases = spark.createDataFrame([("a", 1, "x", True, True, 80.0, 1500.0, 1.0, None, 4000), ("a", 2, "x", False, True, 0.0, 2500.0, None, None, 0)], CASES)
    runs = spark.createDataFrame([("a", "me 1", 123.6, 5, 0.8), ("b", None, None, None, None), ("c", "z", 1.0, 2, None)], "run_id string, reader string, peak_mb double, searches int, search_hit double")
    got = {r.run_id: r.row for r in reports.table(cases, runs).collect()}
    assert got == {"a": "| me 1 | 50% of 2 | 100% | n/a | 2.0 | 2.0 | 1000 | 124 | 80% of 5 |", "b": "| n/a | n/a of 0 | n/a | n/a | 0.0 | 0.0 | 0 | 0 | none |", "c": "| z | n/a of 0 | n/a | n/a | 0.0 | 0.0 | 0 | 1 | failed |"}
    assert reports.TABLE_HEAD.split("\n")[0].count("|") == got["a"].count("|")


def test_run_without_cases_or_scores(spark):
    cases = spark.createDataFrame([("a", 1, None, True, False, None, None, None, None, 40)], CASES)
    runs = spark.createDataFrame([("a", "s", "r", None, None), ("b", None, None, None, None)], "run_id string, suite string, reader string, started timestamp_ntz, peak_mb double")
    got = {r.run_id: r.report.split("\n") for r in reports.run_reports(cases, runs).collect()}
    assert "Overall quality: n/a / 100" in got["a"] and got["a"][-1] == "|  | 1 | 0 | n/a | 100% |" and "Output: 10 tokens per page" in got["a"]
    assert "Success rate: n/a% (0 cases, 0 scored)" in got["b"]


def test_comparison(spark):
    old = spark.createDataFrame([(1, 90.0, True), (2, 50.0, True), (3, 50.0, True), (4, 10.0, True), (5, 70.0, True)], "case_id int, quality double, success boolean")
    new = spark.createDataFrame([(1, 80.0, True), (2, 44.5, True), (3, 57.0, True), (4, None, False), (5, 71.0, True)], "case_id int, quality double, success boolean")
    from pyspark.sql import functions as F

    both = benchmark.compare(old, new).withColumn("pair", F.lit("p"))
    same = benchmark.compare(old, old).withColumn("pair", F.lit("q"))
    got = {r.pair: r.report for r in reports.comparisons(both.union(same), "pair").collect()}
    assert got["p"] == "Mean change of quality: -1.9\nRegressions:\n  1 (-10.0)\n  2 (-5.5)\nImprovements:\n  3 (+7.0)\nNewly failing:\n  4"
    assert got["q"] == "Mean change of quality: +0.0\nNo significant changes."
