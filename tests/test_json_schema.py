"""Schemas as expressions against the plain check, which stands against hand-made cases."""

import json

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.json_schema import SchemaError, errors, violations

NODE = {
    "type": "object", "additionalProperties": False, "required": ["a", "b"],
    "properties": {
        "a": {"type": "string", "minLength": 1, "maxLength": 3, "pattern": "^[a-z]*$"}, "b": {"type": ["integer", "null"], "minimum": 1, "maximum": 9},
        "c": {"enum": ["x", 1, True, None]}, "d": {"const": 2}, "e": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1},
        "f": {"type": "array", "items": {"$ref": "#/$defs/leaf"}, "minItems": 1, "maxItems": 2}, "g": {"type": "object", "additionalProperties": {"type": "boolean"}, "propertyNames": {"pattern": "^k"}, "minProperties": 1},
        "h": {"anyOf": [{"type": "string"}, {"required": ["z"]}]}, "i": {"allOf": [{"if": {"properties": {"m": {"const": "f"}}}, "then": {"required": ["r"]}}]}, "j": True,
    },
    "$defs": {"leaf": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}},
}


def told(schema, value):
    return [(list(p), k, m) for p, k, m in violations(schema, value)]


def compiled(spark, schema, values):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("i", errors(schema, F.parse_json("t")).alias("e")).collect()
    out = {r["i"]: [(list(e["path"]), e["keyword"], e["message"]) for e in r["e"]] for r in rows}
    return [out[i] for i in range(len(values))]


def test_plain_check_by_hand():
    assert told(NODE, {"a": "ab", "b": 1}) == [] and told(NODE, {"a": "ab", "b": None}) == [] and told(NODE, {"a": "ab", "b": 2.0}) == []
    assert told(NODE, 5) == [([], "type", "5 is not of type 'object'")]
    assert told(NODE, {"b": 0, "zz": 1, "yy": 2}) == [
        ([], "required", "'a' is a required property"), ([], "additionalProperties", "Additional properties are not allowed ('yy', 'zz' were unexpected)"),
        (["b"], "minimum", "0 is less than the minimum of 1"),
    ]
    assert told(NODE, {"a": "", "b": True}) == [(["a"], "minLength", "'' should be non-empty"), (["b"], "type", "True is not of type 'integer', 'null'")]
    assert told(NODE, {"a": "ab", "b": 1, "f": [{"n": 1}, {"n": "x"}, {}]}) == [
        (["f"], "maxItems", '[{"n":1},{"n":"x"},{}] is too long'), (["f", "1", "n"], "type", "'x' is not of type 'integer'"), (["f", "2"], "required", "'n' is a required property"),
    ]
    kinds = {(".".join(p), k) for p, k, _ in told(NODE, VALUES[11])}
    assert kinds == {("a", "maxLength"), ("a", "pattern"), ("b", "maximum"), ("c", "enum"), ("d", "const"), ("e", "exclusiveMinimum"), ("g", "propertyNames"), ("g.x", "type"), ("i", "required")}


VALUES = [
    {"a": "ab", "b": 1}, 5, None, [], "x", True, 1.5, {}, {"b": 0, "zz": 1, "yy": 2}, {"a": "", "b": True}, {"a": "ab", "b": 1, "f": [{"n": 1}, {"n": "x"}, {}]}, {"a": "ABCD", "b": 10, "c": 2, "d": True, "e": 0, "g": {"x": 1}, "h": 1, "i": {"m": "f"}},
    {"a": "a", "b": 2, "c": None, "d": 2.0, "e": 0.5, "f": [], "g": {}, "h": {"z": 1}, "i": {"m": "g"}, "j": [{"any": 1}]}, {"a": "ü", "b": 9.5, "c": "x", "g": {"k1": True, "k2": "no"}}, {"a": None, "b": "1", "f": None, "i": {"r": 1}},
]


def test_expressions_equal_the_plain_check(spark):
    got = compiled(spark, NODE, VALUES)
    for value, found in zip(VALUES, got):
        assert sorted(found) == sorted(told(NODE, value)), value


SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-3, 12), st.sampled_from([0.5, 2.5]), st.sampled_from(["", "ab", "x", "ABCD", "ü"]))
JSON = st.recursive(SCALARS, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["a", "b", "c", "f", "g", "h", "i", "k1", "n", "m", "r", "z"]), x, max_size=5)), max_leaves=12)


@settings(max_examples=12, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(JSON, min_size=5, max_size=30))
def test_expressions_equal_the_plain_check_on_any_value(spark, values):
    for value, found in zip(values, compiled(spark, NODE, values)):
        assert sorted(found) == sorted(told(NODE, value)), value


def test_null_columns_have_no_errors(spark):
    row = spark.range(1).select(errors(NODE, F.lit(None).cast("variant")).alias("e")).first()
    assert row["e"] == []


def test_schemas_that_are_not_understood():
    loop = {"$defs": {"x": {"type": "array", "items": {"$ref": "#/$defs/x"}}}, "$ref": "#/$defs/x"}
    for bad in ({"oneOf": []}, {"$ref": "#/$defs/none"}, 5, loop):
        with pytest.raises(SchemaError):
            errors(bad, F.lit(None).cast("variant"))
