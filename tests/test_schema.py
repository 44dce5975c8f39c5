"""Schemas as columns against the checker of single values; globs and migrations in bulk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.schema import schema_errors, violations
from graphloom.model import in_scope, matches_scope, nodes, scope_names
from graphloom.operators.registry import Entry, Registry

VALUES = [
    None, True, False, 0, 1, -3, 2.5, 7, 10**17, "", "a", "abc", "2024-02-29", "2023-02-29", "x@y.z", "10.0.0.256", [], [1], [1, 1.0], [1, "1", True], ["a", 2, 3, "x"], [[1], [1]], [{"a": 1}, {"a": 1}],
    {}, {"a": 1}, {"a": "x", "b": 2}, {"a": 1, "b": {"a": 2, "c": [1, 2, "q"]}}, {"x_1": "s", "x_2": 5, "other": None}, {"kind": "dog", "bark": 1}, {"kind": "cat", "bark": 1}, {"n": 3, "kids": [{"n": 1, "kids": []}, {"n": "one"}]},
    {"a": None, "c": "2024-01-01T10:00:00Z"}, {"credit": 5}, {"credit": 5, "address": "here"}, {"~a/b": 1},
]
SCHEMAS = {
    "bool": [True, False, {}],
    "type": [{"type": t} for t in ("object", "array", "string", "number", "integer", "boolean", "null", ["string", "null"])],
    "enum": [{"enum": [1, "a", None, True, [1], {"a": 1}]}, {"const": 1}, {"const": {"a": 1}}, {"const": False}],
    "numbers": [{"minimum": 1, "maximum": 7}, {"exclusiveMinimum": 1, "exclusiveMaximum": 7}, {"multipleOf": 2}, {"multipleOf": 0.5}],
    "strings": [{"minLength": 1, "maxLength": 3}, {"pattern": "^a"}],
    "format": [{"format": f} for f in ("date", "date-time", "time", "email", "ipv4", "ipv6", "hostname", "uri", "uuid", "duration", "json-pointer", "unknown")],
    "arrays": [{"minItems": 2}, {"items": {"type": "integer"}}, {"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": {"type": "number"}}, {"prefixItems": [True], "items": False}, {"uniqueItems": True}],
    "contains": [{"contains": {"type": "string"}}, {"contains": {"type": "integer"}, "minContains": 2, "maxContains": 2}, {"contains": {"const": 1}, "minContains": 0, "maxContains": 1}],
    "objects": [{"required": ["a", "b"]}, {"properties": {"a": {"type": "integer"}, "b": {"required": ["c"], "properties": {"c": {"maxItems": 2}}}}}, {"minProperties": 2}, {"properties": {"a": True}, "additionalProperties": False}, {"additionalProperties": {"type": "number"}}],
    "patterns": [{"patternProperties": {"^x_": {"type": "string"}}, "additionalProperties": {"type": "null"}}, {"patternProperties": {"a": {"type": "string"}, "b": False}}, {"propertyNames": {"maxLength": 3, "pattern": "^[a-z]"}}],
    "dependent": [{"dependentRequired": {"credit": ["address"]}}, {"dependentSchemas": {"credit": {"properties": {"credit": {"maximum": 4}}}}}],
    "combined": [{"allOf": [{"type": "object"}, {"required": ["a"]}]}, {"anyOf": [{"type": "string"}, {"minimum": 2}]}, {"oneOf": [{"type": "integer"}, {"minimum": 2}]}, {"not": {"type": "object"}}],
    "conditional": [{"if": {"properties": {"kind": {"const": "dog"}}, "required": ["kind"]}, "then": {"required": ["bark"]}, "else": {"not": {"required": ["bark"]}}}, {"if": {"type": "string"}, "then": {"minLength": 2}}],
    "references": [
        {"$ref": "#/$defs/tree", "$defs": {"tree": {"type": "object", "properties": {"n": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}}}},
        {"properties": {"b": {"$ref": "#"}, "a": {"$ref": "#num"}}, "$defs": {"x": {"$anchor": "num", "type": "integer"}}},
        {"properties": {"~a/b": {"$ref": "#/properties/a~1b"}, "a/b": {"type": "string"}}},
    ],
}


@pytest.fixture(scope="module")
def payloads(spark):
    rng = random.Random(1)

    def made(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 5:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice(["a", "b", "n", "kids", "x_1", "credit", "kind"]): made(depth - 1) for _ in range(rng.randrange(4))}
        return [None, rng.random() < 0.5, rng.randrange(9), rng.randrange(9) / 2, rng.choice(["a", "abc", "dog", "12:00:00Z", "P1D", "::1", "1::", "1:2:3:4:5:6:7:8", "http://a.b/c", "/a/~0", "01234567-89ab-cdef-0123-456789abcdef", "2024-13-01"])][kind]

    values = VALUES + [made(3) for _ in range(150)]
    return values, spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").withColumn("data", F.parse_json("j")).repartition(2).cache()


@pytest.mark.parametrize("group", SCHEMAS)
def test_columns_equal_single_values(payloads, group):
    values, df = payloads
    cols = [F.array_sort(violations(s, F.col("data"))).alias(f"s{k}") for k, s in enumerate(SCHEMAS[group])]
    for row in df.select("i", *cols).collect():
        for k, s in enumerate(SCHEMAS[group]):
            assert row[f"s{k}"] == sorted(schema_errors(s, values[row["i"]])), (s, values[row["i"]])


def test_depth_and_bad_references(spark):
    nested = lambda n: {"n": 1, "kids": [nested(n - 1)] if n else []}
    df = spark.createDataFrame([(json.dumps(nested(n)),) for n in (1, 3, 9)], "j string").withColumn("data", F.parse_json("j"))
    tree = SCHEMAS["references"][0]
    told = [r[0] for r in df.select(violations(tree, F.col("data"))).collect()]
    assert told[:2] == [[], []] and len(told[2]) == 1 and "deeper" in told[2][0]
    assert df.select(violations(tree, F.lit(None).cast("variant"))).first()[0] == []
    for bad in ({"$ref": "other.json"}, {"$ref": "#/$defs/x"}, {"$ref": "#gone"}):
        with pytest.raises(GraphError):
            violations(bad, F.col("data"))


def test_globs_in_bulk(spark):
    scopes = ["", "u/a", "u/a/v/b", "u/a/v/x/w/b", "u/x", "u/a.c", "odd"]
    patterns = ["root", "a", "*", "a/*", "**", "**/b", "a/**/b", "a/**", "a.c", "a/b"]
    df = spark.createDataFrame([(s,) for s in scopes], "s string")
    row = {r["s"]: r for r in df.select("s", *(in_scope(F.col("s"), [p]).alias(f"p{k}") for k, p in enumerate(patterns)), in_scope(F.col("s"), ["root", "x"]).alias("two")).collect()}
    for s in scopes[:-1]:
        for k, p in enumerate(patterns):
            assert row[s][f"p{k}"] == matches_scope(p, scope_names(s)), (s, p)
    assert not any(row["odd"][f"p{k}"] for k in range(len(patterns))) and [s for s in scopes if row[s]["two"]] == ["", "u/x"]


def test_audit_and_bound_migrations(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    table = nodes(df, "t", F.col("id"), {"n": F.col("n")}).unionByName(nodes(df, "u", F.col("id"), None, F.lit("p/log")))
    steps = [(0, 1, "to_json(named_struct('data', 'the data of data', 'n', get_json_object(data, '$.n')))"), (1, 3, "to_json(named_struct('seen', get_json_object(data, '$.data'), 'n', array_join(transform(array('x', 'y'), data -> concat(data, '!')), '')))")]
    registry = Registry([Entry("t", json_schema={"properties": {"n": {"type": "integer"}}}, allowed_in=["root"], migrations=steps), Entry("u", allowed_in=["root", "other"])])
    told = {(r["aType"], r["aUid"]): r["violation"] for r in registry.audit(table).collect()}
    assert told == {("u", "a"): "REGISTRY_SCOPE: u is u isn't allowed in log", ("u", "b"): "REGISTRY_SCOPE: u is u isn't allowed in log"} | {k: v for k, v in told.items() if k[0] == "t"}
    assert Registry([]).audit(table).where("violation like 'REGISTRY_VIOLATION%'").count() == 4
    rows = registry.migrated(table.where("aType = 't'").withColumn("v", F.when(F.col("aUid") == "b", 1))).orderBy("aUid").select("aUid", F.to_json("data"), "v").collect()
    assert [tuple(r) for r in rows] == [("a", '{"n":"x!y!","seen":"the data of data"}', 3), ("b", '{"n":"x!y!"}', 3)]
