"""Schemas over VARIANT: what is told, what is refused, values and repair."""

import pytest
from pyspark.sql import functions as F

from quern.functions import schema
from quern.functions.validators import Invalid

S = {
    "type": "object", "required": ["a", "b c"], "additionalProperties": False,
    "properties": {"a": {"type": ["integer", "null"]}, "b c": {"type": "number", "exclusiveMinimum": 0}, "o": {"type": "object", "required": ["x"], "properties": {"x": {"type": "array", "items": {"type": "boolean"}}}}, "s": {"const": "é"}, "t": {"type": "string", "minLength": 2}},
}
CASES = [
    ('{"a": 1, "b c": 0.5}', []), ('{"a": 1.0, "b c": 2}', []), ('{"a": null, "b c": 1e-3}', []), ('{"a": 1.5, "b c": 1}', ["$.a: is not integer or null"]), ("[]", ["$: is not object"]), ("7", ["$: is not object"]), (None, ["$: is no JSON"]), ("{", ["$: is no JSON"]), ("null", ["$: is not object"]),
    ("{}", ["$: a is missing", "$: b c is missing"]), ('{"a": true, "b c": "1"}', ["$.a: is not integer or null", "$.b c: is not number"]), ('{"a": 1, "b c": 0, "zz": {}}', ["$.b c: is not above 0", "$: zz is not known"]),
    ('{"a": 1, "b c": 1, "o": {"x": [true, 1, null]}}', ["$.o.x[1]: is not boolean", "$.o.x[2]: is not boolean"]), ('{"a": 1, "b c": 1, "o": {}}', ["$.o: x is missing"]), ('{"a": 1, "b c": 1, "s": "e", "t": "é"}', ['$.s: is none of "é"', "$.t: is shorter than 2"]), ('{"a": 1, "b c": 1, "s": "é", "t": "éé"}', []),
]


def test_errors(spark):
    rows = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(CASES)], "k int, j string").select("k", schema.errors(schema.parsed(F.col("j")), S).alias("e"))
    got = {r.k: sorted(r.e) for r in rows.collect()}
    assert got == {k: sorted(want) for k, (_, want) in enumerate(CASES)}


def test_only_so_many_are_told(spark):
    many = '{"a": 1, "b c": 1, "o": {"x": [' + ",".join(["1"] * 20) + "]}}"
    (row,) = spark.createDataFrame([(many,)], "j string").select(schema.errors(schema.parsed(F.col("j")), S).alias("e")).collect()
    assert len(row.e) == schema.TOLD


@pytest.mark.parametrize("bad", [[], {"type": "array"}, {"type": "object", "properties": {"a": {"type": "int"}}}, {"properties": {"a": {"oneOf": []}}}, {"properties": {"a": 3}}])
def test_schemas_that_cannot_be_compiled(bad):
    with pytest.raises(Invalid):
        schema.check(bad)


def test_values_and_repair(spark):
    asked = []

    def ask(rows):
        asked.extend(r.id for r in rows.collect())
        return rows.where("id <> 3").select("id", F.lit('```json\n{"a": 5, "b c": 6}\n```').alias("reply"))

    rows = spark.createDataFrame([(1, '{"a": 1, "b c": 2.5}'), (2, "nonsense"), (2, "nonsense"), (3, None)], "id long, reply string")
    got = sorted((r.id, r.rounds, r.a, r.b, list(r.errors)) for r in schema.conforming(rows, S, ask).withColumn("t", schema.typed(F.col("value"), S)).select("id", "rounds", F.col("t.a"), F.col("t.`b c`").alias("b"), "errors").collect())
    assert got == [(1, 1, 1, 2.5, []), (2, 2, 5, 6.0, []), (2, 2, 5, 6.0, []), (3, 2, None, None, ["$: is no JSON"])] and sorted(asked) == [2, 3]
    assert schema.ddl(S) == "struct<`a`: bigint, `b c`: double, `o`: struct<`x`: array<boolean>>, `s`: variant, `t`: string>"


def test_expressions_are_compiled_and_replies_dealt_anew(spark):
    rows = spark.createDataFrame([(k, '{"k": ' + str(k) + "}" if k % 2 else None if k % 3 else "[]") for k in range(40)], "id long, reply string").coalesce(1)
    shape = {"type": "object", "required": ["k", "d"], "properties": {"k": {"type": "integer", "maximum": 9}, "d": {"type": "object", "required": ["x"], "properties": {"x": {"enum": ["a"]}}}}}
    assert "array_sort(" not in rows.select(schema.errors(schema.parsed(F.col("reply")), shape).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    files = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = schema.conforming(rows, shape, lambda wrong: (files.extend(wrong.inputFiles()), wrong.select("id", "reply"))[1])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(files) > 1
    told = {r.id: (list(r.errors), r.rounds) for r in done.collect()}
    assert told[1] == (["$: d is missing"], 2) and told[11] == (["$.k: is above 9", "$: d is missing"], 2)
    assert told[2] == (["$: is no JSON"], 2) and told[6][0][0] == "$: is not object" and len(told) == 40
