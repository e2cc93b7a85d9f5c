"""Schema checks: literal cases, edge values, and random documents against a plain check."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.variants import parse_exact
from quern.operators.reshape import coerce
from quern.operators.schema_rules import FORBIDDEN_PHRASE, GENERATE, SchemaRules, register_rule, _RULES
from quern.operators.validation import batch_summary, invalid_report, split_batch, tag_invalid, with_errors
from quern.sources.readers import items_of, with_document, with_json


def errors_of(spark, schema, docs):
    texts = [d if isinstance(d, str) else json.dumps(d, ensure_ascii=False) for d in docs]
    rows = with_json(spark.createDataFrame(list(enumerate(texts)), "no long, text string"), F.col("text"))
    rules = SchemaRules(schema)
    checked = with_errors(rows, rules).orderBy("no").collect()
    direct = rows.select("no", rules.errors(F.col("item")).alias("e")).orderBy("no").collect()
    assert [r.errors for r in checked] == [r.e for r in direct]
    return [[f"{e.path}: {e.message}" for e in r.errors] for r in checked]


BERTH = {
    "type": "object",
    "required": ["ship", "metres"],
    "properties": {"metres": {"type": "number", "minimum": 2.5, "maximum": 400}, "ship": {"type": "string"}, "agent": {"type": "string", "format": "email"}},
}


def test_flat_object(spark):
    cases = [
        ({"ship": "Möwe", "metres": 2.5, "agent": "pier+9@harbour.example"}, []),
        ({"ship": ""}, ["/: missing required property 'metres'"]),
        ({"ship": ["Möwe"], "metres": 400}, ["/ship: should be string"]),
        ({"ship": "Möwe", "metres": 400.5}, ["/metres: should be <= 400"]),
        ({"ship": "Möwe", "metres": 9, "agent": "harbour.example"}, ['/agent: must match format "email"']),
        (["Möwe", 9], ["/: should be object"]),
        ("false", ["/: should be object"]),
    ]
    assert errors_of(spark, BERTH, [doc for doc, _ in cases]) == [found for _, found in cases]


def test_array(spark):
    crate = {"type": "object", "required": ["kg"], "properties": {"kg": {"type": "number"}, "marks": {"type": "string"}}}
    cases = [
        ([{"kg": 0}, {"kg": -1.5, "marks": ""}, {"kg": 1e9}], []),
        ([{"kg": 3}], ["/: should have at least 2 items"]),
        ([{"marks": "top"}, {"kg": 3}], ["/0: missing required property 'kg'"]),
        ([{"kg": 3}, {"kg": True}], ["/1/kg: should be array of number"]),
    ]
    schema = {"type": "array", "minItems": 2, "maxItems": 3, "items": crate}
    assert errors_of(spark, schema, [doc for doc, _ in cases]) == [found for _, found in cases]


def test_nested(spark):
    schema = {"type": "string"}
    for name in ("label", "crate", "hold", "deck"):
        schema = {"type": "object", "required": [name], "properties": {name: schema}}
    cases = [
        ({"deck": {"hold": {"crate": {"label": ""}}}}, []),
        ({"deck": {"hold": {"crate": {"Label": "x"}}}}, ["/deck/hold/crate: missing required property 'label'"]),
        ({"deck": {"hold": {}}}, ["/deck/hold: missing required property 'crate'"]),
        ({"hold": {}}, ["/: missing required property 'deck'"]),
        ({"deck": {"hold": "full"}}, ["/deck/hold: should be object"]),
    ]
    assert errors_of(spark, schema, [doc for doc, _ in cases]) == [found for _, found in cases]


def test_formats(spark):
    """For each format a text that fits and some that just fail; numbers are never checked."""
    cases = {
        "uuid": ("00000000-0000-4000-8000-00000000000a", ["00000000-0000-4000-8000-00000000000g", ""]),
        "uri": ("urn:isbn:0451450523", ["no scheme", "//host/path only"]),
        "date": ("2000-02-29", ["1900-02-29", "2000-2-9"]),
        "time": ("23:59:59+01:00", ["24:00:00Z", "7:00:00Z"]),
        "date-time": ("1999-12-31T23:59:59.5-05:00", ["1999-04-31T00:00:00Z", "1999-12-31"]),
        "ipv6": ("fe80::7:8", ["fe80:::8", "1:2:3:4:5:6:7:8:9"]),
        "hostname": ("x--1.harbour", ["harbour-.example", "a..b"]),
    }
    schema = {"type": "object", "properties": {k: {"format": k} for k in cases} | {"berth": {"pattern": "^Q[0-7]+$"}}}
    good = {k: fit for k, (fit, _) in cases.items()} | {"berth": "Q07"}
    bad = [(k, text) for k, (_, texts) in cases.items() for text in texts] + [("berth", "Q8"), ("berth", "Q7\n")]
    got = errors_of(spark, schema, [good, dict.fromkeys(good, -3)] + [{k: text} for k, text in bad])
    assert got[:2] == [[], []]
    assert [(k, len(found)) for (k, _), found in zip(bad, got[2:])] == [(k, 1) for k, _ in bad]


def test_enum_and_const(spark):
    schema = {"type": "object", "properties": {
        "tide": {"enum": ["ebb", "flood", "slack"]}, "buoy": {"enum": [8, 16]}, "log": {"enum": [False, None, [1, {"z": 0, "y": []}]]}, "rev": {"const": 7},
    }}
    got = errors_of(spark, schema, [
        {"tide": "slack", "buoy": 16.0, "log": [1, {"y": [], "z": 0}], "rev": 7.0}, {"tide": "Ebb", "buoy": 12},
        {"buoy": "8", "log": True, "rev": [7]}, {"log": None}, {"log": False},
    ])
    assert got[0] == [] and got[3] == [] and got[4] == []
    assert got[1] == ["/buoy: should be one of: 8, 16", "/tide: should be one of: ebb, flood, slack"]
    assert [line.split(":")[0] for line in got[2]] == ["/buoy", "/log", "/rev"]


@pytest.mark.parametrize("text,whole", [
    ("1", True), ("1.0", True), ("1e3", True), ("1.5", False), ('"1"', False), ("null", False),
    ("123456789012345678901234567890", True), ("-0", True), ("1e400", None),
])
def test_integer_values(spark, text, whole):
    got = errors_of(spark, {"type": "object", "properties": {"n": {"type": "integer"}}}, [f'{{"n": {text}}}', "{}"])
    if whole is not None:
        assert (got[0] == []) is whole
    assert got[1] == []


def test_lengths_count_code_points_and_utf16_units(spark):
    schema = {"type": "object", "properties": {
        "a": {"type": "string", "maxLength": 2}, "b": {"type": "string", GENERATE: {"maxLength": 2}},
    }}
    got = errors_of(spark, schema, [{"a": "😀😀", "b": "ab"}, {"a": "😀😀x"}, {"b": "😀x"}])
    assert got == [[], ["/a: should have maximum length of 2"], ["b: custom rule - maximum length should be 2"]]


def test_custom_rules_speak_last(spark):
    schema = {"type": "object", "required": ["items"], GENERATE: {"minLength": 99}, "properties": {"items": {"type": "array", "items": {
        "type": "object", "properties": {"t": {"type": "string", GENERATE: {
            "minLength": 3, "requirements": ["short", FORBIDDEN_PHRASE + "Bad Word\nmore", 7],
        }}},
    }}}}
    got = errors_of(spark, schema, [
        {"items": [{"t": "ok text"}, {"t": "a bAD wORD"}, {"t": "x"}]}, {"items": [{"t": 5}, {"t": "x"}]}, {"items": []}, {},
    ])
    assert got == [
        ['items[1].t: should not contain "Bad Word"', "items[2].t: custom rule - minimum length should be 3"],
        ["/items/0/t: should be array of string"], [], ["/: missing required property 'items'"],
    ]


def test_combinators_refs_and_additional(spark):
    schema = {
        "type": "object",
        "properties": {
            "x": {"anyOf": [{"type": "string"}, {"type": "number", "minimum": 5}]},
            "y": {"oneOf": [{"type": "number"}, {"minimum": 3}]},
            "z": {"not": {"type": "null"}},
            "r": {"$ref": "#/definitions/short", "minLength": 1},
            "no": False,
        },
        "additionalProperties": {"type": "integer"},
        "definitions": {"short": {"type": "string", "maxLength": 2}},
    }
    got = errors_of(spark, schema, [
        {"x": "a", "y": "b", "z": 1, "r": "ab", "more": 3}, {"x": 3}, {"y": 4}, {"z": None}, {"r": "abc"}, {"more/x~": "3"}, {"no": 1},
    ])
    assert got == [
        [], ["/x: must match a schema in anyOf", "/x: should be >= 5", "/x: should be string"],
        ["/y: must match exactly one schema in oneOf"], ["/z: must NOT be valid"], ["/r: should have maximum length of 2"],
        ["/more~1x~0: should be integer"], ["/no: boolean schema is false"],
    ]


def test_unique_and_sizes(spark):
    schema = {"type": "object", "minProperties": 1, "maxProperties": 2, "properties": {"a": {"uniqueItems": True}}}
    got = errors_of(spark, schema, [{"a": [1, 2, "1"]}, {"a": [1, 1.0]}, {"a": [{"x": 1, "y": 2}, {"y": 2, "x": 1}]}, {}, {"a": 1, "b": 2, "c": 3}])
    assert got == [
        [], ["/a: must NOT have duplicate items"], ["/a: must NOT have duplicate items"],
        ["/: must NOT have fewer than 1 properties"], ["/: must NOT have more than 2 properties"],
    ]


def test_bad_schemas_are_refused():
    with pytest.raises(ValueError, match="properties.a.type"):
        SchemaRules({"type": "object", "properties": {"a": {"type": "text"}}})
    with pytest.raises(ValueError, match="Cannot resolve"):
        SchemaRules({"properties": {"a": {"$ref": "#/definitions/none"}}})
    with pytest.raises(ValueError, match="cyclic"):
        SchemaRules({"properties": {"a": {"$ref": "#/properties/a"}}})
    # A schema that refers to itself further down is checked in steps, not by one column.
    with pytest.raises(ValueError, match="recursive"):
        SchemaRules({"$ref": "#/definitions/n", "definitions": {"n": {"properties": {"n": {"$ref": "#/definitions/n"}}}}}).errors(None)


def test_own_keyword(spark):
    register_rule("x-even", lambda node, on: node.fail(node.number % 2 != 0, "x-even", "must be even") if on else None)
    try:
        assert errors_of(spark, {"properties": {"n": {"x-even": True}}}, [{"n": 2}, {"n": 3}]) == [[], ["/n: must be even"]]
    finally:
        _RULES.pop("x-even")


def test_existing_items_report_and_tags(spark):
    schema = {"type": "object", "properties": {"id": {"type": "number"}, "name": {"type": "string"}}, "required": ["id", "name"]}
    text = json.dumps([{"id": 1, "name": "a"}, {"id": 2, "name": "b"}, {"id": 3}, {"id": "x", "name": "d"}])
    docs = with_document(spark.createDataFrame([("list", text), ("one", '{"id": 9, "name": "z"}'), ("bad", "{")], "path string, text string"))
    items = items_of(docs.filter("parse_ok")).select("path", "index", "item")
    checked = with_errors(items, SchemaRules(schema))
    assert {r.path: (r.total, r.valid, r.invalid) for r in batch_summary(checked, "path").collect()} == {"list": (4, 2, 2), "one": (1, 1, 0)}
    valid, invalid = split_batch(checked)
    assert valid.count() == 3 and [r["index"] for r in invalid.orderBy("index").collect()] == [2, 3]
    report = invalid_report(checked, "item", "index").collect()
    assert [(r.label, r.messages) for r in report] == [("3", ["/: missing required property 'name'"]), ("x", ["/id: should be number"])]
    tagged = {(r.path, r["index"]): r._validation for r in tag_invalid(checked).collect()}
    assert tagged[("one", 0)] is None and tagged[("list", 2)].valid is False


def test_coercion(spark):
    schema = {"type": "object", "properties": {
        "n": {"type": "number"}, "i": {"type": "integer"}, "b": {"type": "boolean"}, "s": {"type": "string"}, "z": {"type": "null"},
        "d": {"type": "integer", "default": 7}, "l": {"type": "array", "items": {"type": "integer"}},
    }, "additionalProperties": False}
    docs = ['{"n":"1.5","i":"3","b":"true","s":5,"z":"","l":["1","x",2],"q":1}', '{"n":true,"i":1.5,"b":0,"s":null,"z":0}', "[]"]
    rows = with_json(spark.createDataFrame([(d,) for d in docs], "text string"), F.col("text"))
    got = [json.loads(r.x) for r in rows.select(F.to_json(coerce(schema, F.col("item"))).alias("x")).collect()]
    assert got == [
        {"n": 1.5, "i": 3, "b": True, "s": "5", "z": None, "d": 7, "l": [1, "x", 2]}, {"n": 1, "i": 1.5, "b": False, "s": "", "z": None, "d": 7}, [],
    ]


# -- random documents against a plain recursive check --------------------------------


def plain_check(schema, value, path=""):
    """Slow check of a few keywords, used only here."""
    out, at = [], path or "/"
    kinds = {"string": str, "object": dict, "array": list, "boolean": bool}
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    t = schema.get("type")
    if t:
        ok = {"number": number, "integer": number and float(value).is_integer() if number else False, "null": value is None}.get(
            t, isinstance(value, kinds.get(t, ())) if t in kinds else None)
        if not ok:
            out.append((at, "type"))
    if number:
        out += [(at, "minimum")] if "minimum" in schema and value < schema["minimum"] else []
        out += [(at, "multipleOf")] if "multipleOf" in schema and math.fmod(value, schema["multipleOf"]) else []
    if isinstance(value, str) and "minLength" in schema and len(value) < schema["minLength"]:
        out.append((at, "minLength"))
    if "enum" in schema and not any(type(e) is type(value) and e == value for e in schema["enum"]):
        out.append((at, "enum"))
    if isinstance(value, list):
        out += [(at, "maxItems")] if len(value) > schema.get("maxItems", 99) else []
        for i, v in enumerate(value):
            out += plain_check(schema.get("items", {}), v, f"{path}/{i}")
    if isinstance(value, dict):
        for k in schema.get("required", []):
            out += [(at, "required")] if k not in value else []
        for k, sub in schema.get("properties", {}).items():
            out += plain_check(sub, value[k], f"{path}/{k}") if k in value else []
        if schema.get("additionalProperties") is False:
            out += [(at, "additionalProperties") for k in value if k not in schema.get("properties", {})]
    return out


RANDOM_SCHEMA = {
    "type": "object", "required": ["a", "c"], "additionalProperties": False,
    "properties": {
        "a": {"type": "integer", "minimum": 0, "multipleOf": 2},
        "b": {"type": "string", "minLength": 2, "enum": ["xx", "y"]},
        "c": {"type": "array", "maxItems": 2, "items": {"type": "object", "required": ["a"], "properties": {
            "a": {"type": "boolean"}, "b": {"type": "array", "items": {"type": "null"}},
        }}},
    },
}
scalars = st.one_of(st.none(), st.booleans(), st.integers(-4, 4), st.sampled_from([0.5, 2.0]), st.sampled_from(["", "y", "xx"]))
values = st.recursive(scalars, lambda inner: st.one_of(
    st.lists(inner, max_size=3), st.dictionaries(st.sampled_from("abcd"), inner, max_size=4)), max_leaves=10)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(values, st.fixed_dictionaries({}, optional={"a": values, "b": values, "c": st.lists(values, max_size=3)})), min_size=40, max_size=40))
def test_random_documents(spark, docs):
    rows = with_json(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "no long, text string"), F.col("text"))
    got = {r.no: sorted((e.path, e.keyword) for e in r.errors) for r in with_errors(rows, SchemaRules(RANDOM_SCHEMA)).collect()}
    assert got == {i: sorted(plain_check(RANDOM_SCHEMA, d)) for i, d in enumerate(docs)}


def test_parse_exact(spark):
    texts = ['{"a":1}', '{"a":1} {"b":2}', "1,2", "1] [2", '1} {"v":2', "", " [1] ", "{", '{"a":1,"a":2}', "nul", "1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "no int, t string")
    got = [r.x for r in rows.orderBy("no").select(F.to_json(parse_exact(F.col("t"))).alias("x")).collect()]
    assert got == ['{"a":1}', None, None, None, None, None, "[1]", None, '{"a":2}', None, "1"]
