"""Rules, configurations, catalogue, ledger, inference, files."""

import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.functions.variants import parse_exact
from quern.operators import catalog, checks, configs, files, inference, ledger
from quern.operators.examples import example_document, varied_json
from quern.operators.reshape import fill_fields
from quern.operators.schema_fields import UNREADABLE, corpus_fields, corpus_lint, corpus_references, flatten_schema
from quern.operators.schema_rules import GENERATE, SchemaRules
from quern.operators.validation import with_errors
from quern.session import scratch_path
from quern.sources.readers import (
    read_config, read_documents, read_inventory, read_item_lines, read_items, read_models, read_schema, with_json,
)
from quern.sources.writers import append_history, export


def test_rule_messages(value):
    assert value(checks.required({"name": F.lit("x"), "age": F.lit(None).cast("int"), "email": F.lit("")})) == (
        "Object is missing required fields: age, email"
    )
    assert value(checks.of_type(F.lit("number"), "string", "f")) == "Invalid type for f: expected string, got number"
    assert value(checks.one_of(F.lit("sea"), ["rail", "road"], "route")).endswith("must be one of rail, road")
    for depth, said in ((-0.5, "depth must be at least 0"), (0, None), (40, None), (40.25, "depth must be at most 40")):
        assert value(checks.in_range(F.lit(depth), "depth", 0, 40)) == said
    for code, said in (("", "port must be at least 2 characters"), ("né", None), ("berths", "port must be at most 5 characters")):
        assert value(checks.text_rule(F.lit(code), "port", 2, 5)) == said
    assert value(checks.text_rule(F.lit("DE-7"), "port", pattern="[a-z]$")) == "port has invalid format"
    odd = lambda e: F.when(e % 2 == 1, "is odd")
    assert value(checks.list_rule(F.array(*map(F.lit, (4, 6, 9))), "crates", item=odd)) == "crates[2]: is odd"
    assert value(checks.list_rule(F.array().cast("array<int>"), "crates", low=1)) == "crates must have at least 1 items"
    both = checks.object_messages({
        "a": (F.lit(0), lambda v, n: checks.in_range(v, n, 1)), "b": (F.lit(1), lambda v, n: checks.in_range(v, n, 1)),
        "c": (F.lit("x"), lambda v, n: checks.one_of(v, ["y"], n)),
    })
    assert len(value(both)) == 2


@pytest.mark.parametrize("doc,found", [
    ({"api": {"temperature": 2.0001}, "schema": {"type": "array"}}, ["Temperature must be a number between 0 and 2"]),
    ({"api": {"maxTokens": 0}, "schema": {"type": "array"}}, ["maxTokens must be a positive number"]),
    ({"schema": {}}, ["Schema must have a type property"]), ({}, ["Config is missing required fields: schema"]),
    ({"output": {"format": "text"}}, []), ({"api": {"temperature": 0, "maxTokens": 1}, "schema": {"type": "object"}}, []),
    ({"api": {"temperature": None}, "schema": {"type": "x"}}, ["Temperature must be a number between 0 and 2"]),
])
def test_config_problems(value, doc, found):
    assert value(configs.problems(parse_exact(F.lit(json.dumps(doc))))) == found


def test_config_overview_and_merge(value):
    doc = {"meta": {"name": "N"}, "api": {"model": "m"}, "schema": {"type": "object", "properties": {"a": {}, "b": {}, "c": {}}}, "generation": {"tasks": [{}, {}]}}
    for given, want in ((doc, ("N", "1.0", "m", "object", 3, 2)), ({}, ("Unnamed", "1.0", "default", "unknown", 0, 0))):
        seen = configs.overview(parse_exact(F.lit(json.dumps(given))))
        names = ("name", "version", "model", "schema_type", "properties_count", "tasks_count")
        assert tuple(value(seen[n]) for n in names) == want
    merge = lambda a, b: json.loads(value(F.to_json(configs.merge(parse_exact(F.lit(json.dumps(a))), parse_exact(F.lit(json.dumps(b)))))))
    assert merge({"api": {"model": "a", "t": 1}, "l": [1, 2], "o": 1}, {"api": {"model": "b"}, "l": [3], "s": {"x": None}}) == {
        "api": {"model": "b", "t": 1}, "l": [3], "o": 1, "s": {"x": None}
    }
    assert merge({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}
    changed = configs.with_options(parse_exact(F.lit('{"generation":{"tasks":[{"a":1},{"count":9}]}}')), {"model": "m", "temperature": 0, "count": 4})
    assert json.loads(value(F.to_json(changed))) == {"api": {"model": "m", "temperature": 0}, "generation": {"tasks": [{"a": 1, "count": 4}, {"count": 9}]}}
    with pytest.raises(Exception, match="nested deeper"):
        deep = lambda n: {"a": deep(n - 1)} if n else {}
        merge(deep(30), deep(30))


def test_fill_fields(value):
    schema = {"type": "object", "properties": {
        "id": {"type": "integer", GENERATE: {"value": "{n}"}}, "name": {"type": "string", GENERATE: {"template": "{title}-{index}-{x}"}},
        "map": {GENERATE: {"mapping": {"1": "one", "true": 0}}}, "list": {"type": "array", "items": {"type": "object", "properties": {
            "id": {"type": "string", GENERATE: {"template": "i{index}_{v}"}}, "v": {}}}}, "gone": {GENERATE: {"value": "z"}},
    }}
    ctx = F.create_map(*[F.lit(x) for p in {"n": "5", "index": "2", "title": "ctx"}.items() for x in p])
    doc = '{"id":0,"name":"?","title":"T","index":9,"map":1,"list":[{"id":"a","v":7},{"v":1},3],"more":[1]}'
    run = lambda text, **k: json.loads(value(F.to_json(fill_fields(schema, parse_exact(F.lit(text)), ctx, **k))))
    assert run(doc) == {"id": 5, "name": "T-2-{x}", "title": "T", "index": 9, "map": "one", "list": [{"id": "i2_7", "v": 7}, {"v": 1}, 3], "more": [1]}
    assert run(doc, compat=True)["list"][0] == {"id": "a", "v": 7} and run(doc, compat=True)["id"] == "5"
    assert run('{"map":true}') == {"map": 0} and run('{"map":true}', compat=True) == {"map": True}
    assert run('"text"') == "text"


def test_schema_corpus(spark):
    schema = {"type": "object", "properties": {
        "a": {"type": "string", "minLength": 1, "format": "date"}, "b": {"type": "array", "items": {"type": "number"}},
        "c": {"oneOf": [{"type": "null"}, {"type": "object", "properties": {"d": {"enum": [1], GENERATE: {}}}}]},
        "e": {"type": "object", GENERATE: {"prompt": "p"}}, "r": {"$ref": "#/definitions/x"}, "s": {"$ref": "#/none"},
    }, "definitions": {"x": {"$ref": "#/definitions/y"}, "y": {"$ref": "#/definitions/x"}}}
    assert [f["path"] for f in flatten_schema(schema)] == ["a", "b.[]", "c.oneOf[0]", "e"]
    rows = spark.createDataFrame([(1, json.dumps(schema)), (2, "no json"), (3, '{"type":"string"}')], "id int, doc string")
    got = corpus_fields(rows, ["id"]).orderBy("id", "field_no").collect()
    assert [(r.id, r.path, r.type) for r in got][-1] == (3, "", "string") and got[0].constraints == {"minLength": "1"}
    states = {r.place: r.state for r in corpus_references(rows, ["id"]).collect()}
    assert states["/properties/r"] == "cyclic" and states["/properties/s"] == "dangling"
    deep = {"type": "boolean"}
    for _ in range(300):
        deep = {"type": "object", "properties": {"in": deep}}
    assert [f["path"] for f in flatten_schema(deep)] == [".".join(["in"] * 300)]
    odd = spark.createDataFrame([(1, "{broken"), (2, None), (3, '{"type":"text"}'), (4, '{"type":"string"}')], "id int, doc string")
    assert sorted((r.id, r.place) for r in corpus_lint(odd, ["id"]).collect()) == [(1, UNREADABLE), (2, UNREADABLE), (3, "type")]


def test_examples(spark):
    schema = {"type": "object", "properties": {
        "a": {"type": "integer", "minimum": 3}, "b": {"type": "array", "items": {"enum": ["x", "y"]}}, "c": {"type": "string", GENERATE: {"value": "v"}}, "d": {},
    }}
    assert example_document(schema) == {"a": 3, "b": ["x"], "c": "v", "d": None}
    assert example_document({"type": "array", "items": {"type": "boolean"}}) == [True]
    rows = with_json(spark.range(200), varied_json(schema, F.col("id")))
    assert with_errors(rows, SchemaRules(schema)).filter("not valid").count() == 0
    assert rows.select(F.to_json("item").alias("j")).distinct().count() > 20


MODELS = [
    ("perplexity/sonar", "Sonar", 0.000001, 0.000003, 9999, 5, ["text"], [], True), ("a/gpt-4:free", "G", 0.5, 0.5, 10000, None, ["text", "image"], ["tools"], None),
    ("b/free", "B", 0.0, 0.0, 100000, None, ["audio"], ["response_format"], False), ("c/none", "A", None, None, None, 7, None, None, False),
]


@pytest.fixture(scope="module")
def models(spark):
    rows = [(i, n, c, cr, (p, q), (m,), (10, mod), sp) for i, n, p, q, c, cr, m, sp, mod in MODELS]
    return catalog.project_models(spark.createDataFrame(
        rows, "id string, name string, context_length long, created long, pricing struct<prompt:double,completion:double>, "
        "architecture struct<input_modalities:array<string>>, top_provider struct<max_completion_tokens:long,is_moderated:boolean>, supported_parameters array<string>",
    ))


def test_catalogue(models):
    ids = lambda p: {r.id.split("/")[0] for r in models.filter(p).collect()}
    assert ids(catalog.list_filter("free")) == {"a", "b", "c"} and ids(catalog.list_filter("paid")) == {"perplexity"}
    assert ids(catalog.quick_filter("free")) == {"b", "c"} and ids(catalog.quick_filter("cheap")) == set()
    assert ids(catalog.facet("cheap")) == {"perplexity", "b", "c"} and ids(catalog.facet("unmoderated")) == {"a", "b", "c"}
    assert ids(catalog.facet("medium-context")) == {"a"} and ids(catalog.facet("small-context")) == {"perplexity"}
    assert ids(catalog.facet_filter({"x": ["vision", "audio"], "y": [], "z": ["has-tools"]})) == {"a"}
    assert ids(catalog.facet("nothing")) == set() and ids(catalog.matches_search(" ")) == {"a", "b", "c", "perplexity"}
    assert [r.id.split("/")[0] for r in catalog.newest_first(models).collect()] == ["c", "perplexity", "b", "a"]
    counts = {r.value: r.models for r in catalog.facet_counts(models).collect()}
    assert (counts["free"], counts["cheap"], counts["premium"]) == (2, 1, 1) and counts["small-context"] == 2
    shown = {r.id: r.b for r in models.select("id", catalog.badges().alias("b")).collect()}
    assert shown["perplexity/sonar"] == ["Moderated", "Native Search"] and shown["b/free"] == ["Free", "Audio", "Web Search", "JSON", "100k"]
    prices = {r.id: r.p for r in models.select("id", catalog.search_price_per_thousand().alias("p")).collect()}
    assert prices["perplexity/sonar"] == 8 and prices["b/free"] == 20


class Flaky:
    """Fails by the words of the request."""

    def complete(self, request, attempt):
        if request["say"] == "once" and attempt == 0:
            raise inference.CompletionError("busy", status=429)
        if request["say"] == "slow":
            raise inference.CompletionError("Request timeout", code="TIMEOUT")
        if request["say"] == "broken":
            raise KeyError("no")
        if request["say"] == "empty":
            return {"content": ""}
        return {"content": request["say"], "model": "m", "id": "1", "usage": {"prompt_tokens": 2, "completion_tokens": 3, "prompt_tokens_cost": 0.5}}


def test_inference(spark):
    import pyspark.cloudpickle as cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    waits = spark.sparkContext.accumulator(0)
    said = ["fine", "once", "slow", "broken", "empty"]
    rows = spark.createDataFrame([(s, json.dumps({"say": s})) for s in said], "request_key string, request string")
    got = {r.request_key: r for r in inference.complete_once(
        rows, Flaky, ["request_key"], slots=2, group_delay=0.0, base_delay=0.25, sleep=lambda s: waits.add(int(s * 100))
    ).collect()}
    assert got["fine"].content == "fine" and got["fine"].attempts == 1 and got["fine"].prompt_cost == 0.5 and got["fine"].completion_cost is None
    assert got["once"].attempts == 2 and got["once"].error is None
    assert got["slow"].attempts == 1 and got["slow"].code == "TIMEOUT"
    assert got["broken"].attempts == 3 and got["broken"].code == "CLIENT" and got["empty"].code == "STRUCTURE"
    assert waits.value >= 25 + 25 + 50
    path, quick = scratch_path(spark, "chunks"), {"group_delay": 0.0, "base_delay": 0.0, "sleep": lambda s: None}
    stops = iter([False, False, True])
    assert not inference.complete_in_chunks(rows, Flaky, ["request_key"], path, 4, lambda: next(stops), **quick)
    part = spark.read.parquet(path).count()
    assert inference.complete_in_chunks(rows, Flaky, ["request_key"], path, 2, **quick) and part < len(said)
    answers = spark.read.parquet(path)
    assert sorted(r.request_key for r in inference.settled(answers).collect()) == sorted(said)
    failed = answers.filter("error IS NOT NULL").withColumn("request", F.lit(json.dumps({"say": "fine"}))).select("request_key", "request").distinct()
    asked_again = failed.count()
    assert asked_again and inference.complete_in_chunks(failed, Flaky, ["request_key"], path, 1, **quick)
    assert inference.settled(spark.read.parquet(path)).filter("error IS NULL").count() == len(said)
    other = scratch_path(spark, "other")
    spark.createDataFrame([("x",)], "id string").write.parquet(other)
    with pytest.raises(AnalysisException):
        inference.complete_in_chunks(rows, Flaky, ["request_key"], other, 1, **quick)
    done = spark.createDataFrame([("fine",), ("fine",), ("slow",)], "request_key string")
    assert {r.request_key for r in inference.remaining(rows, done).collect()} == {"once", "broken", "empty"}
    again = inference.replay(rows, spark.createDataFrame([("fine", "x")], "request_key string, content string"))
    assert again.filter("success").count() == 1 and again.count() == 5


def test_costs(spark):
    rows = spark.createDataFrame(
        [(1, "m", 100, 50, None, None, None), (1, "m", 100, 50, 0.1, 0.2, None), (1, "m", 100, 50, 0.1, 0.0, None), (2, "x", 10, 10, None, None, "failed")],
        "run int, model_id string, prompt_tokens long, completion_tokens long, prompt_cost double, completion_cost double, error string",
    )
    models = spark.createDataFrame([("m", 0.01, 0.02)], "id string, prompt double, completion double")
    priced = ledger.with_prices(rows, models)
    assert sorted(round(r.c, 6) for r in priced.select(ledger.request_cost().alias("c")).collect()) == [0, 0.3, 2, 2]
    assert sorted(round(r.c, 6) for r in priced.select(ledger.request_cost(split=False).alias("c")).collect()) == [0, 0.3, 1.5, 1.5]
    totals = {r.run: r for r in ledger.run_totals(priced.withColumn("cost", ledger.request_cost()), "run").collect()}
    assert totals[1].total_tokens == 450 and totals[1].avg_tokens == 150 and totals[1].status == "completed"
    assert totals[2]["items"] == 0 and totals[2].avg_cost == 0 and totals[2].status == "completed_with_errors"


def test_storage_and_metrics(spark):
    rows = spark.createDataFrame([("u", 600), ("u", 300), ("v", 2000)], "owner string, size long")
    usage = ledger.storage_usage(rows, "owner", "size", F.lit(1000).cast("long"))
    assert {r.owner: (r.available, r.percent) for r in usage.collect()} == {"u": (100, 90), "v": (0, 200)}
    new = spark.createDataFrame([("u", 60), ("u", 50), ("w", 5)], "owner string, size long")
    assert {r.owner: (r.fits, r.largest_fits) for r in ledger.upload_check(new, usage, "owner", "size").collect()} == {"u": (False, True), "w": (True, True)}
    feed = spark.createDataFrame([
        ("api", "request", 1, 1, None), ("api", "response", 10, 4, None), ("api", "error", 20, None, None), ("generation", "start", 5, None, None),
        ("generation", "complete", 7, None, None), ("generation", "error", 9, None, None), ("validation", "complete", None, None, True), ("validation", "complete", None, None, False),
    ], "category string, event string, duration long, tokens long, valid boolean")
    got = {r.category: r for r in ledger.metrics(feed).collect()}
    assert (got["api"].total, got["api"].failed, got["api"].avg_duration, got["api"].avg_tokens) == (2, 1, 15.0, 4.0)
    assert (got["generation"].total, got["generation"].total_duration) == (2, 7) and (got["validation"].successful, got["validation"].failed) == (1, 1)
    beats = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0)), ("b", datetime(2024, 1, 1, 0, 1))], "run string, last_heartbeat timestamp")
    assert [r.run for r in ledger.stale_runs(beats, datetime(2024, 1, 1, 0, 5, 30)).collect()] == ["a"]


def test_files(spark, value):
    listed = spark.createDataFrame([("a/b/c.txt", 1), ("a/d.txt", 2), ("e.txt", 4)], "path string, size long")
    assert {r.folder: (r.bytes, r.files) for r in files.folder_sizes(listed).collect()} == {"": (7, 3), "a": (3, 2), "a/b": (1, 1)}
    for path, ok in (("a/b", True), ("../a", False), ("/a", False), ("C:\\a", False)):
        assert value(files.safe_path(F.lit(path))) is ok
    assert value(files.planned_path(F.lit("/u"), F.lit("out/"), F.lit("f"))) == "/u/out/f"
    assert value(files.planned_path(F.lit("/u"), F.lit("/abs"), F.lit("f"))) == "/abs/f"
    assert value(files.file_class(F.lit("x.PNG"))) == "image" and value(files.content_type(F.lit("x.csv"))) == "text/csv"
    assert value(files.valid_text(F.unhex(F.lit("ff")))) is False and value(files.valid_text(F.lit("ok").cast("binary"))) is True


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema": {"type": "object"},\n "x": 1}')
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "items.json").write_text('[{"id": 1},\n {"id": 2}]')
    docs = {r.path.split("/")[-1]: r.parse_ok for r in read_documents(spark, str(tmp_path)).collect()}
    assert docs == {"a.json": True, "b.json": False, "items.json": True}
    assert read_config(spark, str(tmp_path / "a.json"))["x"] == 1 and read_schema(spark, str(tmp_path / "a.json")) == {"type": "object"}
    with pytest.raises(ValueError, match="Invalid JSON"):
        read_config(spark, str(tmp_path / "b.json"))
    with pytest.raises(Exception):
        read_config(spark, str(tmp_path / "none.json"))
    assert read_items(spark, str(tmp_path)).count() == 3
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"id": 1}\n\nbad\n')
    assert sorted(r.parse_ok for r in read_item_lines(spark, str(lines)).collect()) == [False, True]
    (tmp_path / "m.jsonl").write_text(json.dumps({"id": "a/b", "pricing": {"prompt": "0.5"}, "top_provider": {"is_moderated": True}}))
    assert catalog.project_models(read_models(spark, str(tmp_path / "m.jsonl"))).first().prompt == 0.5
    found = read_inventory(spark, str(tmp_path))
    assert "content" not in found.columns and {r.name: r.is_json for r in found.collect()}["m.jsonl"] is False
    path = scratch_path(spark, "history")
    for n in (1, 2):
        append_history(spark.range(n), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        export(spark.range(1), path, "yaml")


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
