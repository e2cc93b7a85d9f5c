"""Slugs, templates, answers, prompts, shown texts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import display
from quern.functions.answers import read_answer, soft_parse, with_answer
from quern.functions.template import map_lookup, render, render_column, render_double, render_double_column
from quern.functions.text import extension, number_text, preview, safe_file_name, translit, utf16_length
from quern.functions.variants import child
from quern.operators.prompts import field_prompts, structure_prompt, system_prompt, type_text, with_request
from quern.operators.schema_rules import GENERATE
from quern.operators.tasks import expand_items, file_name, task_key, with_context, with_fields, with_label
from quern.sources.writers import numbered_name

NOW = datetime(2024, 5, 6, 7, 8, 9, 123000)


@pytest.mark.parametrize("text,slug", [
    ("Подъезд", "pod_ezd"), ("Щука и ёж", "schuka_i_yozh"), ("ЧЁРНЫЙ ЖУК", "chyornyy_zhuk"), ("мышь", "mysh_"), ("  A--b! ", "_a_b_"),
    ("", ""), (None, ""), ("Ünï 42", "_n_42"), ("İK", "_k"), ("ЦЮЯЭ", "tsyuyae"),
])
def test_translit(value, text, slug):
    assert value(translit(F.lit(text).cast("string"))) == slug


def test_number_text(value):
    shown = {1.0: "1", 1.5: "1.5", -0.25: "-0.25", 12345678.5: "12345678.5", 1e15: "1000000000000000", 0.00001: "0.00001"}
    for number, text in shown.items():
        assert value(number_text(F.lit(number))) == text


CTX = {"theme": "Моя тема", "n": "5", "index": "0", "a": "x", "focus_areas": "f", "x": "7"}


@pytest.mark.parametrize("template,text", [
    ("{theme_translit}/{n_minus_2}/{n_plus_1}/{n_minus}", "moya_tema/3/6/4"), ("{missing} {a_b} {}", "{missing} {a_b} {}"),
    ("{focus_areas}{focus_areas_translit}", "f{focus_areas_translit}"), ("{x_minus_0}{x_plus_2z}", "69"),
    ("{{a}}", "{{a}}"), ("{a", "{a"), ("plain", "plain"), ("", ""), ("{a_minus_1}|{a_plus_1}", "NaN|{a_plus_1}"), ("{n_translit}", ""),
])
def test_templates(spark, value, template, text):
    ctx = F.create_map(*[F.lit(x) for pair in CTX.items() for x in pair])
    numeric = F.array(F.lit("n"), F.lit("x"))
    assert value(render(template, map_lookup(ctx), numeric)) == text
    assert value(render_column(F.lit(template), ctx, numeric)) == text


def test_double_braces(value):
    ctx = F.create_map(F.lit("a"), F.lit("1"))
    for template, text in (("{{a}} {a} {{b}} {{a-b}}", "1 {a} {{b}} {{a-b}}"), ("{{{a}}}", "{1}")):
        assert value(render_double(template, map_lookup(ctx))) == text
        assert value(render_double_column(F.lit(template), ctx)) == text


@pytest.mark.parametrize("answer,data,compat", [
    ('```json\n{"a": 1}\n```', '{"a":1}', None), ('text {x ```json [1, 2] ``` more', "[1,2]", None), ('so: {"a": {"b": 2}} done', '{"a":{"b":2}}', None),
    ('[{"a": 1}, {"a": 2}]', '[{"a":1},{"a":2}]', "NULL"), ('{"a": 1} and {"b": 2}', None, None), ('{"a": 1', None, None), ("", None, None),
    ('{"a": 1, "a": 2}', '{"a":2}', None), ("plain", None, None), ("42", "42", None), ("```json\n{bad\n```", None, None), ("} {", None, None),
])
def test_answers(value, answer, data, compat):
    got = value(F.to_json(read_answer(F.lit(answer))))
    assert got == data
    old = value(F.to_json(read_answer(F.lit(answer), compat=True)))
    assert old == (None if compat == "NULL" else data)


def test_answer_errors(spark, value):
    row = with_answer(spark.createDataFrame([("x" * 300,)], "answer string"), "answer").first()
    assert row.parse_error == "Failed to parse JSON response" and row.excerpt == "x" * 200
    assert value(F.to_json(soft_parse(F.lit("words"), F.struct(F.lit(1).alias("k"))))) == '{"content":"words","context":{"k":1}}'
    assert value(child(soft_parse(F.lit('{"a":1}'), F.struct(F.lit(1).alias("k"))), "a").cast("int")) == 1


def test_tasks(spark):
    task = '{"theme":"Тест {date} {theme} {n}","n":3,"difficulty":"medium","answers":4,"list":[1,"b"],"index":9,"off":null}'
    rows = spark.createDataFrame([(1, task, 2), (2, '{"type":"t"}', None), (3, "{}", 0)], "task_id int, task_json string, count int")
    items = expand_items(rows, ["task_id"])
    assert sorted((r.task_id, r["index"]) for r in items.collect()) == [(1, 0), (1, 1), (2, 0)]
    got = {(r.task_id, r["index"]): r for r in with_label(with_context(with_fields(items), NOW)).withColumn("key", task_key(F.col("fields"))).collect()}
    ctx = got[(1, 1)].ctx
    assert ctx["index"] == "1" and ctx["n_minus_1"] == "2" and ctx["n_plus_1"] == "4" and ctx["answers_minus_1"] == "3"
    assert ctx["difficulty_num"] == "2" and ctx["list"] == "1,b" and ctx["off"] == "null" and ctx["date"] == "2024-05-06"
    assert ctx["datetime"] == "2024-05-06T07:08:09.123Z" and ctx["timestamp"] == "1714979289123"
    names = with_context(with_fields(items), NOW).filter("task_id = 1").select(F.map_keys("ctx").alias("k")).first().k
    assert names[:7] == ["theme", "n", "difficulty", "answers", "list", "index", "off"]
    assert got[(1, 0)].label == "Тест 2024-05-06 {theme} 3" and got[(1, 0)].key == "test_date_theme_n__medium"
    assert got[(2, 0)].label == "items" and got[(2, 0)].key == "data_t"


def test_large_tasks_are_cut_into_blocks(spark):
    rows = spark.createDataFrame([(1, 25), (2, 10), (3, 11)], "task_id int, count int")
    items = expand_items(rows, ["task_id"], block=10)
    assert sorted((r.task_id, r["index"]) for r in items.collect()) == [(t, i) for t, n in ((1, 25), (2, 10), (3, 11)) for i in range(n)]


def test_file_names(spark, value):
    rows = with_fields(spark.createDataFrame([('{"theme":"Мир","index":5}',)], "task_json string"))
    named = file_name(F.col("fields"), F.lit("k"), NOW, "{theme_translit}_{topic_translit}_{key}_{date}_{index}.json")
    assert rows.select(named.alias("x")).first().x == "mir__k_2024-05-06_{index}.json"
    assert value(numbered_name(F.lit("a_{index}.txt"), F.lit(0))) == "a_1.txt"
    assert value(numbered_name(F.lit("a.b/c.txt"), F.lit(1))) == "a.b/c_2.txt"
    assert value(numbered_name(F.lit("plain"), F.lit(1))) == "plain_2"


def test_prompts(spark, value):
    assert system_prompt() == "Generate valid JSON data according to the schema."
    assert system_prompt("Base", ["a"], ["b", "c"], "more") == (
        "Base\n\nПримеры хороших результатов:\n1. a\n\n\nПримеры плохих результатов (избегай таких):\n1. b\n2. c\n\n\nmore"
    )
    assert type_text({"anyOf": [{"type": "array"}, {"type": "string"}, {}]}) == "array | string"
    assert type_text({"allOf": [{"type": "a"}, {"type": "b"}]}) == "a & b" and type_text({}) == "any"
    schema = {"type": "object", "properties": {"q": {GENERATE: {"template": 'say "{who}"'}}, "list": {"type": "array", "items": {"type": "string"}}}}
    ctx = F.create_map(F.lit("who"), F.lit('A\n"B"'))
    text = value(structure_prompt(schema, ctx))
    assert '"q": "say \\"A\\n\\"B\\"\\""' in text and '"list": [\n    "<string>"\n  ]' in text and "- who: A" in text
    rows = spark.range(1).select(ctx.alias("ctx"))
    assert [(r.field, r.prompt) for r in field_prompts(rows, schema).collect()] == [
        ("q", 'say "A\n"B""'), ("list.[]", "Сгенерируй значение типа string"),
    ]
    one = with_request(spark.range(2).select("id", F.lit("s").alias("system"), F.lit("u").alias("user")), "m", identity=("id",))
    assert one.select("request").distinct().count() == 1 and one.select("request_key").distinct().count() == 2


def test_shown_texts(value):
    shown = [
        (display.progress_text(F.lit(7), F.lit(10)), "Progress: 7/10 (70%)"), (display.progress_text(F.lit(50), F.lit(100)), "Progress: 50/100 (50%)"),
        (display.cost_text(F.lit(12.3456)), "$12.3456"), (display.cost_text(F.lit(99.99), "€"), "€99.9900"),
        (display.bytes_text(F.lit(500)), "500.00 B"), (display.bytes_text(F.lit(1536)), "1.50 KB"), (display.bytes_text(F.lit(1048576)), "1.00 MB"),
        (display.bytes_text(F.lit(1073741824)), "1.00 GB"), (display.bytes_text_trimmed(F.lit(1536)), "1.5 KB"), (display.bytes_text_trimmed(F.lit(100)), "100 B"),
        (display.bytes_text_short(F.lit(0)), "0 B"), (display.bytes_text_short(F.lit(1536)), "1.5 KB"),
        (display.duration_text(F.lit(500)), "500ms"), (display.duration_text(F.lit(1500)), "1.5s"), (display.duration_text(F.lit(65000)), "1m 5s"),
        (display.duration_text(F.lit(125000)), "2m 5s"), (display.context_text(F.lit(1_000_000)), "1M"), (display.context_text(F.lit(0)), "Unknown"),
        (display.context_text(F.lit(800)), "800"), (display.context_thousands(F.lit(131072)), "131K"), (display.context_thousands(F.lit(None).cast("int")), "?"),
        (display.price_per_million(F.lit(0.0000005), F.lit("m")), "$0.500/M"), (display.price_per_million(F.lit(0.000015), F.lit("m")), "$15.0/M"),
        (display.price_per_million(F.lit(0.1), F.lit("m:free")), "Free"), (display.price_pair(F.lit(0.000001), F.lit(0.000002)), "$1.00/$2.00"),
        (display.provider_name(F.lit("acme/x")), "Acme"), (display.provider_name(F.lit("x")), "Unknown"), (display.provider_name(F.lit("a/x"), F.lit("Own")), "Own"),
        (display.status_label(F.lit("completed_with_errors")), "Completed with errors"), (display.status_label(F.lit("odd")), "odd"),
        (extension(F.lit("a/b.tar.gz")), ".gz"), (extension(F.lit("a/.profile")), ""), (safe_file_name(F.lit("a b/ц.txt")), "a_b__.txt"),
        (preview(F.lit("x" * 81)), "x" * 80 + "..."), (preview(F.lit("x" * 80)), "x" * 80), (utf16_length(F.lit("😀a")), 3),
    ]
    for column, text in shown:
        assert value(column) == text
    now = F.lit(datetime(2024, 1, 10, 12))
    for at, text in ((datetime(2024, 1, 10, 11, 59, 30), "just now"), (datetime(2024, 1, 10, 11, 59), "1 minute ago"), (datetime(2024, 1, 10, 9), "3 hours ago"),
                     (datetime(2024, 1, 9, 12), "1 day ago"), (datetime(2024, 1, 1), "2024-01-01")):
        assert value(display.relative_time(F.lit(at), now)) == text
    assert value(display.relative_time(F.lit(datetime(2024, 1, 9, 12)), now, days=False)) == "2024-01-09"
