"""JSON schemas compiled to expressions over VARIANT (UDF-06, UDF-07, MSC-07): what breaks them where, typed values, one repair.

A schema is checked when it is compiled; the keywords below are known and any other is
refused rather than passed over.  Everything stays in expressions, so documents of any
number are judged without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.validators import Invalid
from quern.scratch import materialize

#: Ways in which a value breaks its schema that are told, by path.
TOLD = 5
TYPES = {"object": "struct", "array": "array", "string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "null": "void"}
KEYWORDS = {
    "type", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "minLength", "maxLength", "pattern", "title", "description", "default", "examples", "$schema", "$id", "$comment",
}
_NONE = "array<string>"


def check(schema: Any, path: str = "$", root: bool = True) -> dict:
    """The schema, if it can be compiled."""
    if not isinstance(schema, dict):
        raise Invalid("schema", schema, f"{path}: an object is needed")
    if root and schema.get("type", "object") != "object":
        raise Invalid("schema", schema, "the root must be an object")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in TYPES:
            raise Invalid("schema", schema, f"{path}: there is no type {kind!r}")
    if bad := sorted(set(schema) - KEYWORDS):
        raise Invalid("schema", schema, f"{path}: {', '.join(bad)} is not known here")
    for k, held in schema.get("properties", {}).items():
        check(held, f"{path}.{k}", False)
    if "items" in schema:
        check(schema["items"], f"{path}[]", False)
    return schema


def _step(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _is(kind: Column, value: Column, name: str) -> Column:
    """Whether a variant of type text ``kind`` is of a schema's type; a whole number written with a point is an integer."""
    number = kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    if name == "integer":
        double = F.try_variant_get(value, "$", "double")
        return number & (kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)") | (double == F.floor(double)))
    if name == "number":
        return number
    return kind.startswith({"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name])


def _said(value: Any) -> str:
    import json

    return json.dumps(value, ensure_ascii=False)


def errors(value: Column, schema: dict, path: Column | None = None) -> Column:
    """Array of ``path: what is wrong`` of a variant; a SQL null, which is no JSON, is told at the root.

    A value that is missing breaks nothing, so no part stands behind a condition, and none below a function that Spark
    interprets but the members of arrays: equal paths and types are then taken once.
    """
    if path is None:
        every = F.concat(F.when(value.isNull(), F.array(F.lit("$: is no JSON"))).otherwise(F.array().cast(_NONE)), errors(value, check(schema), F.lit("$")))
        if schema.get("type") is None:
            every = F.when(value.isNotNull() & ~_is(F.schema_of_variant(value), value, "object"), F.array(F.lit("$: is not object"))).otherwise(every)
        return F.slice(F.sort_array(every), 1, TOLD)
    kind = F.schema_of_variant(value)
    kinds = schema.get("type")
    parts: list[Column] = []

    def tell(wrong: Column, what: str) -> None:
        parts.append(F.when(wrong, F.array(F.concat(path, F.lit(f": {what}")))).otherwise(F.array().cast(_NONE)))

    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        ok = _is(kind, value, kinds[0])
        for k in kinds[1:]:
            ok = ok | _is(kind, value, k)
        tell(~ok, f"is not {' or '.join(kinds)}")
    if "enum" in schema or "const" in schema:
        known = schema["enum"] if "enum" in schema else [schema["const"]]
        tell(~F.to_json(value).isin([F.to_json(F.parse_json(F.lit(_said(x)))) for x in known]), f"is none of {', '.join(map(_said, known))}")
    number = F.when(kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    for word, wrong, what in (
        ("minimum", lambda b: number < b, "is below"), ("maximum", lambda b: number > b, "is above"),
        ("exclusiveMinimum", lambda b: number <= b, "is not above"), ("exclusiveMaximum", lambda b: number >= b, "is not below"),
    ):
        if word in schema:
            tell(F.coalesce(wrong(F.lit(float(schema[word]))), F.lit(False)), f"{what} {schema[word]}")
    text = F.when(kind.startswith("STRING"), F.try_variant_get(value, "$", "string"))
    if "minLength" in schema:
        tell(F.coalesce(F.char_length(text) < schema["minLength"], F.lit(False)), f"is shorter than {schema['minLength']}")
    if "maxLength" in schema:
        tell(F.coalesce(F.char_length(text) > schema["maxLength"], F.lit(False)), f"is longer than {schema['maxLength']}")
    if "pattern" in schema:
        tell(F.coalesce(~text.rlike(schema["pattern"]), F.lit(False)), f"does not match {schema['pattern']}")
    held = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    if "minItems" in schema:
        tell(F.coalesce(F.size(held) < schema["minItems"], F.lit(False)), f"has fewer than {schema['minItems']} items")
    if "maxItems" in schema:
        tell(F.coalesce(F.size(held) > schema["maxItems"], F.lit(False)), f"has more than {schema['maxItems']} items")
    if "items" in schema:
        inner = F.transform(held, lambda x, i: errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        parts.append(F.coalesce(F.flatten(inner), F.array().cast(_NONE)))
    is_object = kind.startswith("OBJECT")
    names = list(dict.fromkeys([*schema.get("properties", {}), *schema.get("required", [])]))
    for name in names:
        child = F.try_variant_get(value, _step(name), "variant")
        if name in schema.get("required", []):
            tell(is_object & child.isNull(), f"{name} is missing")
        if name in schema.get("properties", {}):
            parts.append(errors(child, schema["properties"][name], F.concat(path, F.lit(f".{name}"))))
    if schema.get("additionalProperties") is False:
        more = F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array(*map(F.lit, names)).cast(_NONE))
        parts.append(F.coalesce(F.transform(F.when(is_object, more), lambda k: F.concat(path, F.lit(": "), k, F.lit(" is not known"))), F.array().cast(_NONE)))
    return F.concat(*parts) if parts else F.array().cast(_NONE)


def ddl(schema: dict) -> str:
    """The Spark type of a schema's values; variant where it says nothing or several things."""
    kind = schema.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), None) if len([k for k in kind if k != "null"]) == 1 else None
    if kind == "object" or (kind is None and "properties" in schema):
        fields = [f"`{k}`: {ddl(v)}" for k, v in schema.get("properties", {}).items()]
        return f"struct<{', '.join(fields)}>" if fields else "variant"
    if kind == "array":
        return f"array<{ddl(schema['items']) if 'items' in schema else 'variant'}>"
    return TYPES.get(kind, "variant") if kind != "null" else "variant"


def typed(value: Column, schema: dict) -> Column:
    """A conforming variant as a value of the schema's Spark type; null where it does not fit."""
    return F.try_variant_get(value, "$", ddl(check(schema)))


def parsed(reply: Column) -> Column:
    """A reply as a variant: the whole of it, or a fenced block within it; null if neither is JSON."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    return F.coalesce(F.try_parse_json(reply), F.try_parse_json(F.nullif(fenced, F.lit(""))))


def repair_request(reply: Column, wrong: Column) -> Column:
    """What a model is told about a reply that breaks the schema."""
    return F.concat(F.lit("This reply breaks the schema:\n- "), F.array_join(wrong, "\n- "), F.lit("\nGive the corrected JSON and nothing else. The reply was:\n"), F.coalesce(reply, F.lit("")))


def conforming(replies: DataFrame, schema: dict, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, value, errors, rounds) of replies (id, reply): those that break the schema are asked for once more.

    ``ask`` gets (id, reply, request) of these alone and gives (id, reply).  The first round is written, so nothing is asked twice,
    an id that repeats neither.  Replies are dealt anew, so few large partitions do not bind few tasks.
    """

    def judge(rows: DataFrame) -> DataFrame:
        return rows.select("id", "reply", parsed(F.col("reply")).alias("value")).withColumn("errors", errors(F.col("value"), schema))

    if ask is None:
        return judge(replies).select("id", "value", "errors", F.lit(1).alias("rounds"))
    first = materialize(judge(replies.repartition("id", "reply")), "replies")
    wrong = first.where("size(errors) > 0")
    asked = wrong.dropDuplicates(["id"]).select("id", "reply", repair_request(F.col("reply"), F.col("errors")).alias("request"))
    again = materialize(ask(asked), "repairs")
    second = judge(wrong.select("id").join(again.select("id", "reply").dropDuplicates(["id"]), "id", "left"))
    done = first.where("size(errors) = 0").select("id", "value", "errors", F.lit(1).alias("rounds"))
    return done.unionByName(second.select("id", "value", "errors", F.lit(2).alias("rounds")))
