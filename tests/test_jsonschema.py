"""JSON Schema compiler: hand-written cases per keyword (tier A and B)."""

import json

import pytest
from pyspark.sql import functions as F

from pipewright.functions import jsonschema as JS
from pipewright.sources.fixtures import FULL_SCHEMA


def errors(spark, schema, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    df = df.withColumn("v", JS.strict_parse(F.col("p")))
    out = JS.errors_column(df, schema, F.col("v"))
    rows = sorted(out.select("i", "v", "errors").collect())
    return [None if r["v"] is None else list(r["errors"]) for r in rows]


def test_strict_parse_rejects_trailing_text(spark):
    cases = ['{"a":1}', '{"a":1} x', '1] x', '{"a":1},{"b":2}', '', 'null', '[1,2]', '"s"', '{"a":']
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = [r[0] for r in df.select(JS.strict_parse(F.col("p")).isNotNull()).collect()]
    assert got == [True, False, False, False, False, True, True, True, False]


def test_full_schema_catalogue(spark):
    got = errors(spark, FULL_SCHEMA, [
        '{"order_id":"1","amount":5,"currency":"USD"}',
        '{"order_id":"1","amount":-99.99,"currency":"USD"}',
        '{"order_id":"1","amount":1,"currency":"JPY"}',
        '{"bad_field":"x","amount":"not-a-number","created_at":12345}',
        '[1,2]',
        '{"order_id":1,"amount":null,"currency":true}',
        '{"order_id":"1","amount":12.0,"currency":"EUR"}',
    ])
    assert got[0] == []
    assert got[1] == ["/amount: must be >= 0 (got -99.99)"]
    assert got[2] == ['/currency: must be one of [USD, EUR, GBP] (got "JPY")']
    assert got[3] == ["/: missing required property 'order_id'", "/: missing required property 'currency'",
                      "/amount: must be number (got string)"]
    assert got[4] == ["/: must be object (got array)"]
    assert got[5] == ["/order_id: must be string (got number)", "/amount: must be number (got null)",
                      "/currency: must be string (got boolean)"]
    assert got[6] == []


def test_integer_and_type_lists(spark):
    s = {"properties": {"n": {"type": "integer"}, "m": {"type": ["string", "null"]}}}
    got = errors(spark, s, ['{"n":1.0,"m":null}', '{"n":1.5,"m":"x"}', '{"n":"1","m":2}'])
    assert got[0] == []
    assert got[1] == ["/n: must be integer (got number)"]
    assert got[2] == ["/n: must be integer (got string)", "/m: must be string or null (got number)"]


def test_numeric_and_string_bounds(spark):
    s = {"properties": {
        "a": {"maximum": 10, "exclusiveMinimum": 0, "multipleOf": 0.5},
        "b": {"minLength": 2, "maxLength": 3, "pattern": "^[a-z]+$"}}}
    got = errors(spark, s, ['{"a":2.5,"b":"abc"}', '{"a":0,"b":"a"}', '{"a":10.25,"b":"abcd"}', '{"a":"x","b":"AB"}'])
    assert got[0] == []
    assert got[1] == ["/a: must be > 0 (got 0)", "/b: length must be >= 2 (got 1)"]
    assert got[2] == ["/a: must be <= 10 (got 10.25)", "/a: must be a multiple of 0.5 (got 10.25)",
                      "/b: length must be <= 3 (got 4)"]
    assert got[3] == ['/b: must match pattern "^[a-z]+$"']


def test_object_keywords(spark):
    s = {"type": "object", "properties": {"a": {}}, "additionalProperties": False,
         "minProperties": 1, "maxProperties": 2, "dependencies": {"a": ["b"]}}
    got = errors(spark, s, ['{}', '{"a":1,"b":2}', '{"a":1,"c":3,"d":4}'])
    assert got[0] == ["/: must have at least 1 properties (got 0)"]
    assert got[1] == ["/: additional properties not allowed: 'b'"]
    assert got[2] == ["/: must have at most 2 properties (got 3)",
                      "/: additional properties not allowed: 'c', 'd'",
                      "/: property 'b' is required by 'a'"]


def test_pattern_properties_and_names(spark):
    s = {"patternProperties": {"^n_": {"type": "number"}}, "propertyNames": {"maxLength": 3}}
    got = errors(spark, s, ['{"n_1":1}', '{"n_2":"x","long":1}'])
    assert got[0] == []
    assert got[1] == ["/n_2: must be number (got string)", "/: invalid property names: long"]


def test_array_keywords(spark):
    s = {"type": "array", "items": {"type": "integer"}, "minItems": 1, "maxItems": 3,
         "uniqueItems": True, "contains": {"minimum": 5}}
    got = errors(spark, s, ['[5]', '[]', '[1,1,"x",7]'])
    assert got[0] == []
    assert got[1] == ["/: must have at least 1 items (got 0)", "/: must contain at least one matching item"]
    assert got[2] == ["/: must have at most 3 items (got 4)", "/: items must be unique",
                      "/2: must be integer (got string)"]


def test_tuple_items(spark):
    s = {"items": [{"type": "string"}, {"type": "number"}], "additionalItems": False}
    got = errors(spark, s, ['["a",1]', '[1,"a",3]'])
    assert got[0] == []
    assert got[1] == ["/0: must be string (got number)", "/1: must be number (got string)",
                      "/: must have at most 2 items (got 3)"]


def test_combinators_and_ref(spark):
    s = {"definitions": {"pos": {"type": "number", "minimum": 0}},
         "properties": {
             "a": {"anyOf": [{"type": "string"}, {"$ref": "#/definitions/pos"}]},
             "b": {"oneOf": [{"type": "number"}, {"type": "integer"}]},
             "c": {"not": {"const": "x"}},
             "d": {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "boolean"}},
             "e": {"allOf": [{"enum": [1, 2]}, {"const": 2}]}}}
    got = errors(spark, s, ['{"a":"s","b":1.5,"c":"y","d":"ab","e":2}',
                            '{"a":-1,"b":1,"c":"x","d":3,"e":1}'])
    assert got[0] == []
    assert got[1][0].startswith("/a: must match at least one schema in anyOf")
    assert "/b: must match exactly one schema in oneOf (got 2)" in got[1]
    assert "/c: must not match the schema in not" in got[1]
    assert "/d: must be boolean (got number)" in got[1]
    assert "/e: must be 2 (got 1)" in got[1]


def test_boolean_schemas(spark):
    got = errors(spark, {"properties": {"x": False, "y": True}}, ['{"y":1}', '{"x":1}'])
    assert got == [[], ["/x: not allowed"]]


@pytest.mark.parametrize("bad", [
    {"type": "strng"}, {"minimum": "0"}, {"required": "a"}, {"format": "email", "foo": 1},
    {"$ref": "http://x/y"}, {"$ref": "#/definitions/missing"}, {"pattern": "("}, "not json {",
    {"unevaluatedProperties": False},
])
def test_bad_schemas_rejected_at_registration(bad):
    with pytest.raises(JS.SchemaCompileError):
        JS.parse_schema(bad if not isinstance(bad, str) else bad)


def test_recursive_ref_rejected(spark):
    s = {"definitions": {"n": {"properties": {"c": {"$ref": "#/definitions/n"}}}}, "$ref": "#/definitions/n"}
    with pytest.raises(JS.SchemaCompileError):
        JS.compile_errors(s, F.col("v"))


def test_annotations_ignored():
    JS.parse_schema(json.dumps({"title": "t", "description": "d", "$schema": "x", "type": "object"}))


def test_non_finite_number_is_not_json(spark):
    got = errors(spark, FULL_SCHEMA, ['{"order_id":"1","amount":1e400,"currency":"USD"}',
                                      '{"order_id":"1","amount":-1e400,"currency":"USD"}',
                                      '{"order_id":"1","amount":1e300,"currency":"USD"}'])
    assert got == [["payload is not valid JSON"], ["payload is not valid JSON"], []]
