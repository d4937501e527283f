"""Queries over JSON held in tables (the clicks' ``props`` stand for replies of models), and reports of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import schema
from quern.plans import reports
from quern.registry import query, table

PROPS = {
    "type": "object",
    "required": ["k", "device"],
    "properties": {
        "k": {"type": "integer", "minimum": 0, "maximum": 90},
        "device": {"type": "object", "required": ["os"], "properties": {"os": {"enum": ["web", "ios", "android"]}, "ver": {"type": "string", "pattern": "^[0-9]+\\.[0-9]$"}}},
        "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "maxLength": 1}},
        "items": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["sku"], "properties": {"sku": {"type": "integer"}, "qty": {"type": "integer", "exclusiveMaximum": 4}}}},
    },
}

_J = "CASE WHEN json_valid(props) THEN props END"


def _sql_errors(j: str) -> str:
    """What breaks ``PROPS`` in a JSON text, by DuckDB's JSON functions."""
    items = f"coalesce(CASE WHEN json_type({j}, '$.items') = 'ARRAY' THEN json_extract({j}, '$.items[*].qty') END, [])"
    tags = f"coalesce(CASE WHEN json_type({j}, '$.tags') = 'ARRAY' THEN json_extract({j}, '$.tags[*]') END, [])"
    return f"""CASE WHEN {j} IS NULL THEN ['$: is no JSON'] ELSE list_sort(list_concat(list_filter([
  CASE WHEN json_type({j}, '$.k') IS NULL THEN '$: k is missing' END, CASE WHEN json_type({j}, '$.device') IS NULL THEN '$: device is missing' END, CASE WHEN json_type({j}, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN '$.k: is not integer' END,
  CASE WHEN json_type({j}, '$.k') = 'UBIGINT' AND json_extract_string({j}, '$.k')::BIGINT > 90 THEN '$.k: is above 90' END,
  CASE WHEN json_extract_string({j}, '$.device.os') NOT IN ('web', 'ios', 'android') THEN '$.device.os: is none of "web", "ios", "android"' END,
  CASE WHEN NOT regexp_matches(json_extract_string({j}, '$.device.ver'), '^[0-9]+\\.[0-9]$') THEN '$.device.ver: does not match ^[0-9]+\\.[0-9]$' END,
  CASE WHEN json_type({j}, '$.tags') <> 'ARRAY' THEN '$.tags: is not array' END, CASE WHEN json_array_length({j}, '$.tags') > 2 THEN '$.tags: has more than 2 items' END,
  CASE WHEN json_type({j}, '$.items') = 'ARRAY' AND json_array_length({j}, '$.items') < 1 THEN '$.items: has fewer than 1 items' END], lambda x: x IS NOT NULL),
  list_filter(list_transform(range(len({tags})), lambda i: CASE WHEN json_type(({tags})[i + 1]) <> 'VARCHAR' THEN '$.tags[' || i || ']: is not string' END), lambda x: x IS NOT NULL),
  list_filter(list_transform(range(len({items})), lambda i: CASE WHEN ({items})[i + 1]::BIGINT >= 4 THEN '$.items[' || i || '].qty: is not below 4' END), lambda x: x IS NOT NULL)))[1:5] END"""


@query(f"SELECT click_id, array_to_string(errors, '; ') AS errors, CASE WHEN json_type(j, '$.k') = 'UBIGINT' THEN json_extract_string(j, '$.k')::BIGINT ELSE -1 END AS k, coalesce(json_extract_string(j, '$.device.os'), '') AS os FROM (SELECT click_id, {_J} AS j, {_sql_errors(f'({_J})')} AS errors FROM clicks)")
def props_errors(spark, d):
    """What breaks a schema, by path, and two values by their own types."""
    value = schema.parsed(F.col("props"))
    held = table(spark, d, "clicks").select("click_id", value.alias("v")).withColumn("errors", schema.errors(F.col("v"), PROPS))
    number = F.when(F.schema_of_variant(F.try_variant_get("v", "$.k", "variant")) == "BIGINT", F.try_variant_get("v", "$.k", "bigint"))
    return held.select("click_id", F.array_join("errors", "; ").alias("errors"), F.coalesce(number, F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get("v", "$.device.os", "string"), F.lit("")).alias("os"))


_FIXED = """CASE WHEN click_id % 3 = 0 THEN NULL WHEN click_id % 3 = 1 THEN '{"k": ' || click_id % 95 || ', "device": {"os": "web"}}' ELSE props END"""


@query(f"""WITH a AS (SELECT click_id, props, {_sql_errors(f'({_J})')} AS e FROM clicks), b AS (SELECT click_id, e, CASE WHEN len(e) = 0 THEN props ELSE {_FIXED} END AS props FROM a),
c AS (SELECT click_id, len(e) = 0 AS first, {_J} AS j, {_sql_errors(f'({_J})')} AS errors FROM b)
SELECT click_id, array_to_string(errors, '; ') AS errors, CASE WHEN first THEN 1 ELSE 2 END AS rounds, CASE WHEN len(errors) = 0 THEN json_extract_string(j, '$.k')::BIGINT ELSE -1 END AS k,
  CASE WHEN len(errors) = 0 AND json_type(j, '$.tags') = 'ARRAY' THEN json_array_length(j, '$.tags')::INTEGER ELSE -1 END AS n_tags FROM c""")
def props_repaired(spark, d):
    """Values that break the schema are asked for once more: a third comes back in a fence, a third unchanged, a third not at all."""
    n = F.col("id")

    def ask(rows):
        new = F.concat(F.lit('Here it is:\n```json\n{"k": '), n % 95, F.lit(', "device": {"os": "web"}}\n```'))
        return rows.where(n % 3 > 0).select("id", F.when(n % 3 == 1, new).otherwise(F.col("reply")).alias("reply"))

    done = schema.conforming(table(spark, d, "clicks").select(F.col("click_id").alias("id"), F.col("props").alias("reply")), PROPS, ask)
    held = done.withColumn("t", F.when(F.size("errors") == 0, schema.typed(F.col("value"), PROPS)))
    return held.select(F.col("id").alias("click_id"), F.array_join("errors", "; ").alias("errors"), "rounds", F.coalesce("t.k", F.lit(-1)).alias("k"), F.coalesce(F.size("t.tags"), F.lit(-1)).alias("n_tags"))


# Reports


_CASES = "SELECT d.source AS run_id, d.doc_id AS case_id, d.lang AS category, length(d.text) > 300 AS success, l.quality IS NOT NULL AS scored, CASE WHEN l.quality IS NOT NULL THEN (d.n_chars % 101)::DOUBLE END AS quality, d.n_chars AS ms, (d.n_chars % 2)::DOUBLE AS hit, (d.n_chars % 4 > 0)::INT::DOUBLE AS gone FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id"
_N = lambda x, k: f"coalesce(printf('%.{k}f', round_even({x}, {k})), 'n/a')"
_P = lambda x: f"CASE WHEN {x} IS NULL THEN 'n/a' ELSE {_N(f'{x} * 100', 0)} || '%' END"


def _report_cases(spark, d):
    n = F.col("n_chars")
    held = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("label"))
    docs = table(spark, d, "documents").join(held, "doc_id", "left")
    scored = F.col("label").isNotNull()
    return docs.select(F.col("source").alias("run_id"), F.col("doc_id").alias("case_id"), F.col("lang").alias("category"), (F.char_length("text") > 300).alias("success"), scored.alias("scored"), F.when(scored, (n % 101).cast("double")).alias("quality"), n.cast("double").alias("latency_ms"), (n % 2).cast("double").alias("expect_hit"), (n % 4 > 0).cast("double").alias("expect_absent_ok"), n.alias("markdown_chars"))


@query(f"""WITH c AS ({_CASES}), t AS (SELECT run_id, count(*) AS n, count(quality) AS s, avg(success::INT) AS ok, avg(quality) AS q, avg(ms) AS mean, median(ms) AS mid, avg(hit) FILTER (success) AS hit, avg(gone) FILTER (success) AS gone, avg(ms // 4) FILTER (success) AS tokens FROM c GROUP BY run_id),
g AS (SELECT run_id, string_agg('| ' || category || ' | ' || n || ' | ' || s || ' | ' || {_N('q', 1)} || ' | ' || {_P('ok')} || ' |', chr(10) ORDER BY category) AS lines FROM (SELECT run_id, coalesce(category, '') AS category, count(*) AS n, count(quality) AS s, avg(quality) AS q, avg(success::INT) AS ok FROM c GROUP BY 1, 2) GROUP BY run_id),
w AS (SELECT run_id, string_agg('- ' || case_id || ': ' || {_N('quality', 1)} || CASE WHEN success THEN '' ELSE ', failed' END, chr(10) ORDER BY r) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY quality, case_id) AS r FROM c WHERE scored) WHERE r <= 5 GROUP BY run_id)
SELECT t.run_id, 'Run: ' || t.run_id || chr(10) || 'Suite: all   Reader: r ' || t.run_id || chr(10) || 'Started: 2024-01-02 03:04:05' || chr(10) || 'Overall quality: ' || {_N('q', 1)} || ' / 100' || chr(10) || 'Success rate: ' || {_N('ok * 100', 1)} || '% (' || n || ' cases, ' || s || ' scored)' || chr(10)
 || 'Latency: median ' || {_N('mid / 1000', 1)} || ' s, mean ' || {_N('mean / 1000', 1)} || ' s' || chr(10) || 'Content kept: ' || {_P('hit')} || '   Boilerplate gone: ' || {_P('gone')} || chr(10) || 'Output: ' || {_N('tokens', 0)} || ' tokens per page' || chr(10) || 'Peak memory: n/a MB' || chr(10)
 || chr(10) || '| Category | N | Scored | Quality | Success |' || chr(10) || '| --- | ---: | ---: | ---: | ---: |' || chr(10) || g.lines || CASE WHEN worst IS NULL THEN '' ELSE chr(10) || chr(10) || 'Worst scored cases' || chr(10) || worst END AS report
FROM t JOIN g ON g.run_id = t.run_id LEFT JOIN w ON w.run_id = t.run_id""")
def run_reports(spark, d):
    """Sources are runs, languages categories, documents with a label scored cases."""
    c = _report_cases(spark, d)
    runs = c.select("run_id").distinct().select("run_id", F.lit("all").alias("suite"), F.concat(F.lit("r "), "run_id").alias("reader"), F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05")).alias("started"), F.lit(None).cast("double").alias("peak_mb"))
    return reports.run_reports(c, runs)
