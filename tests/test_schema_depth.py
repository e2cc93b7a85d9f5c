"""Schema keywords that look further, recursive schemas, and merges of any depth."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions.text import number_text
from quern.operators.merging import merge_documents
from quern.operators.schema_rules import SchemaRules, lint_types
from quern.operators.validation import with_errors
from quern.sources.readers import with_json


def errors(spark, schema, docs):
    """For each document, the sorted (path, message) of its errors."""
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    rows = with_errors(with_json(df, F.col("t")), SchemaRules(schema)).select("i", "errors").collect()
    return [sorted((e.path, e.message) for e in r.errors) for r in sorted(rows, key=lambda r: r.i)]


def test_conditions(spark):
    schema = {"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["a"]}, "else": {"maxProperties": 1}}
    found = errors(spark, schema, [{"k": 1}, {"k": 1, "a": 0}, {"k": 2}, {"k": 2, "x": 0}, {}])
    then, other = 'must match "then" schema', 'must match "else" schema'
    assert found == [[("/", "missing required property 'a'"), ("/", then)], [], [], [("/", "must NOT have more than 1 properties"), ("/", other)], []]


def test_contains_and_tails(spark):
    schema = {"properties": {
        "c": {"contains": {"type": "string", "minLength": 2}}, "any": {"contains": {}},
        "p": {"items": [{"type": "integer"}, {"type": "string"}], "additionalItems": False},
        "q": {"items": [{"type": "integer"}], "additionalItems": {"type": "boolean"}},
    }}
    docs = [{"c": ["ab", 1]}, {"c": ["a"]}, {"c": []}, {"c": 5}, {"any": []}, {"any": [0]}, {"p": [1, "x"]}, {"p": [1, "x", 2]}, {"p": ["y"]}, {"q": [1, True, 3]}]
    none = "must contain at least 1 valid item(s)"
    assert errors(spark, schema, docs) == [
        [], [("/c", none), ("/c/0", "should have minimum length of 2")], [("/c", none)], [], [("/any", none)], [], [],
        [("/p", "must NOT have more than 2 items")], [("/p/0", "should be array of integer")], [("/q/2", "should be boolean")],
    ]


def test_patterns_names_and_dependencies(spark):
    schema = {
        "properties": {"a": {}}, "patternProperties": {"^x": {"type": "integer"}, "y$": {"maximum": 3}}, "additionalProperties": {"type": "null"},
        "propertyNames": {"maxLength": 3}, "dependencies": {"a": ["b", "xa"], "b": {"required": ["a"]}},
    }
    docs = [{"xy": 5}, {"x": "s"}, {"zz": None}, {"zz": 1}, {"long": None}, {"a": 1, "b": None, "xa": 1}, {"a": 1}, {"b": None}, {"a/~": 1}]
    both = ("/", "must have properties b, xa when property a is present")
    assert errors(spark, schema, docs) == [
        [("/xy", "should be <= 3")], [("/x", "should be integer")], [], [("/zz", "should be null")],
        [("/", "property name must be valid"), ("/", "should have maximum length of 3")], [], [both, both],
        [("/", "missing required property 'a'")], [("/a~1~0", "should be null")],
    ]


def test_nullable(spark):
    schema = {"properties": {"a": {"type": "string", "nullable": True}, "b": {"type": "string"}}}
    assert errors(spark, schema, [{"a": None}, {"a": 1}, {"b": None}]) == [[], [("/a", "should be string")], [("/b", "should be string")]]


TREE = {"type": "object", "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#"}}}, "required": ["v"], "additionalProperties": False}


def tree_errors(node, path="", of=""):
    """The rules of TREE, read plainly."""
    if not isinstance(node, dict):
        return [(path or "/", f"should be {of}object")]
    found = [(path or "/", f"has unknown property '{k}'") for k in node if k not in ("v", "kids")]
    found += [] if "v" in node else [(path or "/", "missing required property 'v'")]
    if "v" in node and not isinstance(node["v"], int):
        found.append((f"{path}/v", "should be integer"))
    for i, kid in enumerate(node.get("kids", [])):
        found += tree_errors(kid, f"{path}/kids/{i}")
    return found


def grown(levels, n=0):
    node = {"v": "x"} if n % 2 else {"w": 1}
    for i in range(levels):
        node = {"v": i if (i + n) % 9 else "s", "kids": [{"v": 1}, node, 7][: 2 + (i % 5 == 0)]}
    return node


def test_recursive_tree_of_any_depth(spark):
    docs = [grown(d, d) for d in (0, 1, 8, 9, 17)] + [[], {"v": 1}]
    assert errors(spark, TREE, docs) == [sorted(tree_errors(d)) for d in docs]


def test_recursion_below_any_of(spark):
    """Whole results below are judged: one bad leaf makes every ``anyOf`` above fail."""
    schema = {"anyOf": [{"type": "string"}, {"type": "object", "properties": {"n": {"$ref": "#"}}, "required": ["n"]}]}

    def bad(node):
        return not (isinstance(node, str) or (isinstance(node, dict) and "n" in node and not bad(node["n"])))

    docs = []
    for depth in (0, 1, 7):
        for leaf in ("end", 5, {}):
            node = leaf
            for _ in range(depth):
                node = {"n": node}
            docs.append(node)
    found = errors(spark, schema, docs)
    assert [bool(f) for f in found] == [bad(d) for d in docs]
    assert sum(m == "must match a schema in anyOf" for _, m in found[7]) == 8


def test_definitions_that_call_each_other(spark):
    schema = {
        "$ref": "#/definitions/row", "definitions": {
            "row": {"type": "array", "items": {"$ref": "#/definitions/cell"}},
            "cell": {"type": "object", "properties": {"rows": {"$ref": "#/definitions/row"}, "n": {"type": "number"}}},
        },
    }
    doc, want = {"n": "bad"}, "/0/n"
    for _ in range(12):
        doc, want = {"rows": [doc]}, "/0/rows" + want
    assert errors(spark, schema, [[doc], [{"rows": 5}], []]) == [[(want, "should be number")], [("/0/rows", "should be array")], []]


@pytest.mark.parametrize("schema", [{"$ref": "#"}, {"allOf": [{"$ref": "#/definitions/a"}], "definitions": {"a": {"not": {"$ref": "#/definitions/a"}}}}, {"$ref": "#/no"}])
def test_references_without_end_or_target(schema):
    with pytest.raises(ValueError):
        SchemaRules(schema)


def test_lint_looks_everywhere():
    wrong = {"type": "text"}
    schema = {"not": wrong, "if": wrong, "items": [wrong, {"contains": wrong}], "definitions": {"d": wrong}, "patternProperties": {"x": wrong}, "dependencies": {"a": ["b"], "c": wrong}}
    assert sorted(lint_types(schema)) == sorted(["not.type", "if.type", "items.0.type", "items.1.contains.type", "definitions.d.type", "patternProperties.x.type", "dependencies.c.type"])


def test_merge_of_any_depth(spark):
    def nested(levels, inner, side):
        for i in range(levels):
            inner = {"x/~": inner, side: i, "both": {side: i}}
        return inner

    def plain(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: plain(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}
        return b

    pairs = [(nested(d, {"leaf": 1}, "l"), nested(e, {"leaf": None, "list": [1]}, "r")) for d, e in ((0, 0), (11, 11), (12, 12), (13, 13), (26, 24), (3, 20))]
    pairs += [({"a": 1}, {"a": {"b": 2}}), ({"a": {"b": 2}}, {"a": 1}), ({"a": 1}, {}), (5, {"a": 1})]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(98, None, '{"z":1}'), (99, '{"z":1}', None)], "i int, a string, b string")
    rows = with_json(with_json(df, F.col("a"), "base"), F.col("b"), "over")
    found = {r.i: json.loads(r.t) for r in merge_documents(rows, "base", "over").select("i", F.to_json("merged").alias("t")).collect()}
    assert found == {i: plain(a, b) for i, (a, b) in enumerate(pairs)} | {98: {"z": 1}, 99: {"z": 1}}


@pytest.mark.parametrize("number, text", [
    (1e-20, "1e-20"), (1.5e21, "1.5e+21"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1.25e-7, "1.25e-7"), (-0.000001, "-0.000001"),
    (0.00012, "0.00012"), (123456789.125, "123456789.125"), (1e7, "10000000"), (12345678.5, "12345678.5"), (-2.5e-10, "-2.5e-10"), (0.0, "0"), (float("nan"), "NaN"),
])
def test_number_text(value, number, text):
    assert value(number_text(F.lit(number))) == text


@pytest.mark.parametrize("name, good, bad", [
    ("duration", ["P1Y2M3DT4H5M6S", "PT36H", "P2W"], ["P", "PT", "1Y", "P1W2D"]),
    ("iso-time", ["10:20:30", "10:20:30Z", "10:20:30.5+02:00"], ["25:00:00", "10:20"]),
    ("iso-date-time", ["2024-02-29T10:20:30", "2024-02-29 10:20:30Z"], ["2023-02-29T10:20:30", "2024-02-29"]),
    ("uri-reference", ["", "../a?b=c#d", "http://x/y"], ["a b", "\\x"]),
    ("url", ["https://a.example/x?y", "ftp://b.example:21/"], ["mailto:x@y.example", "https://nodots"]),
    ("json-pointer", ["", "/a/b~0c", "/"], ["a/b", "/~2"]),
    ("json-pointer-uri-fragment", ["#", "#/a%20b"], ["/a", "#a"]),
    ("relative-json-pointer", ["0", "1/a", "2#"], ["01/a", "/a"]),
    ("byte", ["", "YWJj", "YQ=="], ["YQ=", "a b="]),
    ("int32", [1, -2147483648, 3.0], [2147483648, 1.5]),
    ("int64", [9007199254740993], [0.5]),
    ("double", [1.5, 2], []), ("password", ["x", ""], []), ("no-such-format", ["x", 1], []),
])
def test_formats(spark, name, good, bad):
    found = errors(spark, {"format": name}, [*good, *bad])
    assert found == [[] for _ in good] + [[("/", f'must match format "{name}"')] for _ in bad]


def test_images_in_messages(spark):
    from quern.operators import chat

    parts = spark.createDataFrame([(1, 0, -1, "user", "u"), (1, 1, -1, "user", 'say "x"'), (1, 1, 4, "user", " file"), (1, 2, -1, "assistant", "a"), (2, 0, -1, "assistant", "z")], "conv_id long, turn long, part long, role string, text string")
    files = spark.createDataFrame([(1, 9, "b.PNG", b"\x00\xff"), (1, 3, "a.bmp", b"abc" * 40), (1, 5, "c.txt", b"t"), (1, 6, "d.gif", None), (2, 7, "e.webp", b"w")], "conv_id long, no long, name string, data binary")
    found = {(r.conv_id, r.turn): json.loads(r.message) for r in chat.message_json(parts, chat.image_urls(files), "no").collect()}
    import base64

    url = lambda kind, data: {"type": "image_url", "image_url": {"url": f"data:image/{kind};base64,{base64.b64encode(data).decode()}"}}
    assert found == {
        (1, 0): {"role": "user", "content": "u"}, (1, 2): {"role": "assistant", "content": "a"}, (2, 0): {"role": "assistant", "content": "z"},
        (1, 1): {"role": "user", "content": [{"type": "text", "text": 'say "x" file'}, url("jpeg", b"abc" * 40), url("png", b"\x00\xff")]},
    }


@pytest.mark.parametrize("doc, text", [
    ([[1, [2, None]], "a,b", {"x": [1]}, [], [[]], [{"y": {"z": 2}}, 1e-20]], "1,2,,a,b,[object Object],,,[object Object],1e-20"),
    ([["q\"uo]te", "é\n"], [True, [False]]], "q\"uo]te,é\n,true,false"), ([[[[[["deep"]]]]]], "deep"), ([1, None, "x"], "1,,x"),
])
def test_lists_in_lists_as_text(value, doc, text):
    from quern.functions.variants import parse_exact, text_of

    assert value(text_of(parse_exact(F.lit(json.dumps(doc))))) == text


def test_texts_are_merged_in_one_pass():
    from quern.operators.merging import joined_texts

    deep = lambda n, inner: '{"x":' * n + inner + "}" * n
    got = joined_texts(deep(300, '{"a":1.50,"b":[1,{"c":2}],"q":"\\u00e9\\""}'), deep(300, '{"b":[0.10],"n":null,"z":-1e-400}'))
    assert got.replace(" ", "") == deep(300, '{"a":1.50,"b":[0.10],"q":"\\u00e9\\"","n":null,"z":-1e-400}')
    assert joined_texts("[1]", "2") == "2" and joined_texts('{"a":1}', "null") == "null"
    assert joined_texts('{"a":"\\u0000"}', '{"a":1.5}') is None


def test_documents_keep_the_types_that_text_would_change(spark):
    rows = [(0, '{"a":{"b":1e2,"c":0.50}}', '{"a":{"d":"2"}}'), (1, '{"a":{"b":1.0}}', '{"a":{"d":[1,"x",1e2]}}'), (2, '{"a":{"b":1}}', '{"a":{"d":0.5}}'), (3, None, '{"e":1}'), (4, '{"e":1}', None)]
    df = spark.createDataFrame(rows, "k int, l string, r string").select("k", F.try_parse_json("l").alias("l"), F.try_parse_json("r").alias("r"))
    got = {r.k: r.t for r in merge_documents(df, "l", "r").select("k", F.to_json("merged").alias("t")).collect()}
    assert got == {0: '{"a":{"b":100.0,"c":0.5,"d":"2"}}', 1: '{"a":{"b":1,"d":[1,"x",100.0]}}', 2: '{"a":{"b":1,"d":0.5}}', 3: '{"e":1}', 4: '{"e":1}'}


def test_work_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    from quern import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    spark.range(0, 2500, 1, 9).write.parquet(str(tmp_path / "rows"))
    dealt = session.spread(spark.read.parquet(str(tmp_path / "rows")))
    sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 25 and max(sizes) < 150 and sum(sizes) == 2500
