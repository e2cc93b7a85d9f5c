"""Queries for tasks, contexts, templates, prompts, inference and answers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.answers import soft_parse, with_answer
from quern.functions.template import column_lookup, render, render_column, render_double, render_double_column
from quern.functions.text import LATIN, number_text, translit
from quern.functions.pinned import pin
from quern.functions.variants import child
from quern.operators import chat, inference
from quern.operators.examples import example_json, varied_json
from quern.operators.ledger import history_rows, run_totals
from quern.operators.prompts import (
    field_prompts, stream_prompt, structure_prompt, system_prompt, system_prompt_column, text_prompt, with_request,
)
from quern.operators.reshape import fill_fields
from quern.operators.schema_rules import GENERATE, SchemaRules
from quern.operators.tasks import (
    expand_items, file_name, planned_items, task_key, tasks_of, with_context, with_fields, with_label,
)
from quern.operators.validation import with_errors
from quern.plans.registry import query
from quern.plans.tables import NOW, event_props, table
from quern.session import materialize, scratch_path, spread
from quern.sources.readers import ordered_messages, read_ledger, with_document, with_json
from quern.sources.writers import append_history, read_json_documents, write_json_documents

STAMP = "2024-01-31T12:30:45.678Z"
EPOCH = "1706704245678"


def _task_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration per order with two tasks; the second has no count."""
    o = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus"))
    first = F.struct(F.col("o_orderpriority").alias("theme"), (F.char_length("o_orderpriority") - 5).alias("count"))
    second = F.struct(F.col("o_orderstatus").alias("topic"))
    tasks = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]"))
    text = F.concat(F.lit('{"generation":{"tasks":'), tasks, F.lit("}}"))
    return with_document(o.select("o_orderkey", "o_orderstatus", text.alias("text"))).drop("text", "parse_ok")


@query("task_expand", """
    SELECT o_orderkey, 0 AS task_no, CAST(i AS BIGINT) AS "index"
    FROM orders, unnest(range(length(o_orderpriority) - 5)) AS r(i)
    UNION ALL
    SELECT o_orderkey, 1, CAST(0 AS BIGINT) FROM orders
""")
def task_expand(spark, sf_dir):
    tasks = tasks_of(_task_configs(spark, sf_dir))
    return expand_items(tasks, ["o_orderkey", "task_no"]).select("o_orderkey", "task_no", "index")


@query("planned_items", """
    SELECT o_orderstatus, CAST(sum(length(o_orderpriority) - 5 + 1) AS BIGINT) AS planned FROM orders GROUP BY 1
""")
def planned(spark, sf_dir):
    return planned_items(tasks_of(_task_configs(spark, sf_dir)), "o_orderstatus")


def _order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    level = F.when(F.col("o_orderstatus") == "F", "easy").when(F.col("o_orderstatus") == "O", "medium").otherwise("hard")
    task = F.to_json(F.struct(
        F.col("o_orderpriority").alias("theme"), level.alias("difficulty"), F.col("o_custkey").alias("answers"),
        F.col("o_totalprice").alias("price"),
    ))
    return o.select("o_orderkey", F.col("o_orderkey").alias("index"), task.alias("task_json"))


def _num(sql: str) -> str:
    """Number text in SQL: no fraction on whole numbers."""
    return f"regexp_replace(CAST({sql} AS VARCHAR), '\\.0$', '')"


SLUG_PRIORITY = "lower(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]+', '_', 'g'))"


@query("context_build", f"""
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS ix, '2024-01-31' AS day, '{STAMP}' AS now, '{EPOCH}' AS stamp,
      {SLUG_PRIORITY} AS slug,
      CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END AS level,
      CAST(o_custkey - 1 AS VARCHAR) AS fewer, CAST(o_custkey + 1 AS VARCHAR) AS more,
      {_num('o_totalprice - 1')} AS cheaper, {_num('o_totalprice + 1')} AS dearer,
      {_num('o_totalprice')} AS price,
      15 AS names
    FROM orders
""")
def context_build(spark, sf_dir):
    rows = with_context(with_fields(_order_tasks(spark, sf_dir)), NOW)
    ctx = lambda key: F.try_element_at("ctx", F.lit(key))
    return rows.select(
        "o_orderkey", ctx("index").alias("ix"), ctx("date").alias("day"), ctx("now").alias("now"), ctx("timestamp").alias("stamp"),
        ctx("theme_translit").alias("slug"), ctx("difficulty_num").alias("level"), ctx("answers_minus_1").alias("fewer"),
        ctx("answers_plus_1").alias("more"), ctx("price_minus_1").alias("cheaper"), ctx("price_plus_1").alias("dearer"),
        ctx("price").alias("price"), F.size("ctx").alias("names"),
    )


SLUG_NAME = "lower(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g'))"


@query("template_const", f"""
    SELECT p_partkey,
      p_name || '/' || (p_size + 1) || '/' || (p_size - 2) || '/' || (p_size - 1) || '/' || {SLUG_NAME}
        || '//{{missing}}/' || {_num('p_retailprice')} || '/{{part_name_translit}}/{{}}/NaN/{{name_plus_1}}' AS text,
      p_name || ' {{{{gone}}}} {{name}}' AS doubled
    FROM part
""")
def template_const(spark, sf_dir):
    values = column_lookup({
        "name": F.col("p_name"), "size": F.col("p_size").cast("string"), "price": F.col("price"),
        "part_name": F.col("p_name"),
    })
    template = (
        "{name}/{size_plus_1}/{size_minus_2}/{size_minus_0}/{name_translit}/{size_translit}/{missing}/{price}"
        "/{part_name_translit}/{}/{name_minus_1}/{name_plus_1}"
    )
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_retailprice").withColumn("price", number_text(F.col("p_retailprice")))
    return p.select(
        "p_partkey",
        render(template, values, F.array(F.lit("size"), F.lit("price"))).alias("text"),
        render_double("{{name}} {{gone}} {name}", values).alias("doubled"),
    )


@query("template_column", f"""
    SELECT p_partkey,
      CASE p_type
        WHEN 'ECONOMY' THEN p_name || '-' || (p_size + 3)
        WHEN 'LARGE' THEN {SLUG_NAME} || '|{{nothing}}|' || (p_size - 1)
        WHEN 'MEDIUM' THEN '{{' || p_name || '}} {{}} {{unknown_plus_1}}'
        ELSE 'plain ' || p_brand || '{{' END AS text,
      CASE p_type
        WHEN 'ECONOMY' THEN '{{name}}-{{size_plus_3}}'
        WHEN 'LARGE' THEN '{{name_translit}}|{{nothing}}|{{size_minus_1}}'
        WHEN 'MEDIUM' THEN p_name || ' {{}} {{unknown_plus_1}}'
        ELSE 'plain {{brand}}{{' END AS doubled
    FROM part
""")
def template_column(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand", "p_type")
    template = (
        F.when(F.col("p_type") == "ECONOMY", "{name}-{size_plus_3}")
        .when(F.col("p_type") == "LARGE", "{name_translit}|{nothing}|{size_minus_1}")
        .when(F.col("p_type") == "MEDIUM", "{{name}} {} {unknown_plus_1}")
        .otherwise("plain {brand}{")
    )
    ctx = F.create_map(
        F.lit("name"), F.col("p_name"), F.lit("{name"), F.concat(F.lit("{"), F.col("p_name")),
        F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"),
    )
    rows = p.withColumn("t", template).withColumn("ctx", ctx)
    return rows.select(
        "p_partkey", render_column(F.col("t"), F.col("ctx")).alias("text"),
        render_double_column(F.col("t"), F.col("ctx")).alias("doubled"),
    )


# Latin letters of the documents turned into Cyrillic ones, so that whole texts
# go through the table.
TO_CYRILLIC = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "абцдефгхийклмнопярстувщыжзАБЩДЕФЁЧЖЪ")


def _slug_sql(column: str) -> str:
    text = column
    for letter, latin in LATIN.items():
        text = f"replace(replace({text}, '{letter}', '{latin}'), '{letter.upper()}', '{latin}')"
    return f"lower(regexp_replace({text}, '[^a-zA-Z0-9]+', '_', 'g'))"


@query("translit", f"""
    SELECT doc_id, {_slug_sql('text')} AS slug,
      {_slug_sql(f"translate(text, '{TO_CYRILLIC[0]}', '{TO_CYRILLIC[1]}')")} AS cyrillic_slug
    FROM documents
""")
def translit_documents(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return d.select(
        "doc_id", translit(F.col("text")).alias("slug"), translit(F.translate("text", *TO_CYRILLIC)).alias("cyrillic_slug")
    )


@query("task_key_file", """
    WITH t AS (
      SELECT c_custkey, c_nationkey,
        CASE WHEN c_nationkey < 20 THEN c_name || ' {date} {theme} {topic}' END AS theme,
        'Topic ' || c_nationkey AS topic,
        CASE WHEN c_nationkey < 5 THEN 'easy' END AS difficulty, c_mktsegment AS kind
      FROM customer
    ), k AS (
      SELECT *, lower(regexp_replace(coalesce(theme, topic), '[^a-zA-Z0-9]+', '_', 'g')) || '_' || coalesce(difficulty, kind) AS task_key
      FROM t
    )
    SELECT c_custkey, coalesce(replace(replace(theme, '{date}', '2024-01-31'), '{topic}', topic), topic) AS label,
      task_key,
      coalesce(lower(regexp_replace(theme, '[^a-zA-Z0-9]+', '_', 'g')), '') || '-'
        || lower(regexp_replace(topic, '[^a-zA-Z0-9]+', '_', 'g')) || '_2024-01-31_' || task_key || '_{index}.json' AS file,
      task_key || '.json' AS plain_file
    FROM k
""")
def task_key_file(spark, sf_dir):
    c = spread(table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    task = F.to_json(F.struct(
        F.when(F.col("c_nationkey") < 20, F.concat("c_name", F.lit(" {date} {theme} {topic}"))).alias("theme"),
        F.concat(F.lit("Topic "), F.col("c_nationkey").cast("string")).alias("topic"),
        F.when(F.col("c_nationkey") < 5, "easy").alias("difficulty"),
        F.col("c_mktsegment").alias("type"),
    ))
    rows = c.select("c_custkey", F.lit(0).cast("bigint").alias("index"), task.alias("task_json"))
    rows = with_label(with_context(with_fields(rows), NOW))
    rows = rows.withColumn("task_key", task_key(F.col("fields")))
    named = "{theme_translit}-{topic_translit}_{date}_{key}_{index}.json"
    return rows.select(
        "c_custkey", "label", "task_key", file_name(F.col("fields"), F.col("task_key"), NOW, named).alias("file"),
        file_name(F.col("fields"), F.col("task_key"), NOW, None).alias("plain_file"),
    )


@query("system_prompt", """
    WITH p AS (
      SELECT c_custkey,
        'Write about ' || c_mktsegment || chr(10) || chr(10) || 'Примеры хороших результатов:' || chr(10)
          || '1. ' || c_name || chr(10) || '2. ' || c_mktsegment || chr(10)
          || CASE WHEN c_nationkey > 12 THEN chr(10) || chr(10) || 'Примеры плохих результатов (избегай таких):' || chr(10)
               || '1. ' || c_name || chr(10) ELSE '' END
          || CASE WHEN c_acctbal > 5000 THEN chr(10) || chr(10) || 'rich' ELSE '' END AS prompt,
        c_name
      FROM customer
    )
    SELECT c_custkey, prompt,
      sha256(CAST(c_custkey AS VARCHAR) || chr(31)
        || '{"model":"m/one","messages":[{"role":"system","content":"' || replace(prompt, chr(10), '\\n')
        || '"},{"role":"user","content":"' || c_name
        || '"}],"temperature":0.6,"max_tokens":4000,"response_format":{"type":"json_object"}}') AS request_key
    FROM p
""")
def system_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    none = F.array().cast("array<string>")
    rows = c.withColumn("system", system_prompt_column(
        F.concat(F.lit("Write about "), F.col("c_mktsegment")),
        F.array("c_name", "c_mktsegment"),
        F.when(F.col("c_nationkey") > 12, F.array("c_name")).otherwise(none),
        F.when(F.col("c_acctbal") > 5000, "rich").otherwise(""),
    )).withColumn("user", F.col("c_name"))
    out = with_request(rows, "m/one", identity=("c_custkey",))
    return out.select("c_custkey", F.col("system").alias("prompt"), "request_key")


ORDER_ITEM_SCHEMA = {
    "type": "object",
    "properties": {
        "items": {"type": "array", "items": {
            "type": "object",
            "properties": {
                "id": {"type": "string", GENERATE: {"template": "item_{index}"}},
                "title": {"type": "string", GENERATE: {"prompt": "Title for {theme}"}},
                "score": {"anyOf": [{"type": "integer"}, {"type": "string"}]},
                "note": {"type": "string", GENERATE: {"minLength": 3}},
            },
        }},
        "any": {},
    },
}


@query("structure_prompt", f"""
    SELECT o_orderkey,
      'Сгенерируй JSON объект со следующей структурой:' || chr(10) || chr(10)
      || '{{' || chr(10) || '  "items": [' || chr(10) || '    {{' || chr(10)
      || '      "id": "item_' || o_orderkey || '",' || chr(10)
      || '      "title": "Title for ' || o_orderpriority || '",' || chr(10)
      || '      "score": "<integer | string>",' || chr(10)
      || '      "note": "<string>"' || chr(10)
      || '    }}' || chr(10) || '  ],' || chr(10) || '  "any": "<any>"' || chr(10) || '}}' || chr(10) || chr(10)
      || 'Контекст:' || chr(10) || '- theme: ' || o_orderpriority || chr(10)
      || '- difficulty: ' || CASE o_orderstatus WHEN 'F' THEN 'easy' WHEN 'O' THEN 'medium' ELSE 'hard' END || chr(10)
      || '- answers: ' || o_custkey || chr(10) || '- price: ' || {_num('o_totalprice')} || chr(10)
      || '- index: ' || o_orderkey || chr(10) || '- date: 2024-01-31' || chr(10)
      || '- datetime: {STAMP}' || chr(10) || '- now: {STAMP}' || chr(10) || '- timestamp: {EPOCH}' || chr(10)
      || '- theme_translit: ' || {SLUG_PRIORITY} || chr(10)
      || '- difficulty_num: ' || CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END || chr(10)
      || CASE WHEN o_custkey <> 0 THEN '- answers_minus_1: ' || (o_custkey - 1) || chr(10) ELSE '' END
      || CASE WHEN o_custkey = 0 THEN '- answers_minus_1: -1' || chr(10) ELSE '' END
      || '- answers_plus_1: ' || (o_custkey + 1) || chr(10)
      || '- price_minus_1: ' || {_num('o_totalprice - 1')} || chr(10)
      || '- price_plus_1: ' || {_num('o_totalprice + 1')} || chr(10)
      || chr(10) || chr(10) || 'Важно: возвращай только валидный JSON без дополнительного текста.' AS prompt,
      'Write: ' || o_orderpriority || ' no ' || o_orderkey AS text_prompt
    FROM orders
""")
def structure_prompts(spark, sf_dir):
    rows = with_context(with_fields(_order_tasks(spark, sf_dir)), NOW)
    return rows.select(
        "o_orderkey", structure_prompt(ORDER_ITEM_SCHEMA, F.col("ctx"), F.col("numeric")).alias("prompt"),
        text_prompt("Write: {theme} no {index}", F.col("ctx"), F.col("numeric")).alias("text_prompt"),
    )


@query("stream_prompt", """
    SELECT c_custkey, 'Generate valid JSON data that matches this schema:' || chr(10) || '{' || chr(10) || '  "type": "string"'
      || chr(10) || '}' || chr(10) || chr(10) || 'Context: {"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS prompt
    FROM customer
""")
def stream_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    ctx = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return c.select("c_custkey", stream_prompt({"type": "string"}, ctx).alias("prompt"))


FIELD_SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": "string", GENERATE: {"template": "{name_translit}_{size}"}},
        "kind": {"type": "string", GENERATE: {"value": "{brand}"}},
        "title": {"type": "string", "maxLength": 80, GENERATE: {
            "prompt": "Title of {name}", "minLength": 10, "requirements": ["short", "clear"],
        }},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2, "maxLength": 9}},
        "level": {"type": "integer", "enum": [1, 2, 3]},
        "price": {"type": "number", "minimum": 1, "maximum": 50, "pattern": "x"},
    },
}


@query("field_prompt", f"""
    SELECT p_partkey, 'id' AS field, {SLUG_NAME} || '_' || p_size AS prompt FROM part
    UNION ALL SELECT p_partkey, 'kind', p_brand FROM part
    UNION ALL SELECT p_partkey, 'title', 'Title of ' || p_name || chr(10) || chr(10) || 'Требования:' || chr(10)
      || '1. short' || chr(10) || '2. clear' || chr(10) || chr(10) || 'Минимальная длина: 10 символов' || chr(10)
      || 'Максимальная длина: 80 символов' FROM part
    UNION ALL SELECT p_partkey, 'tags.[]', 'Сгенерируй значение типа string (длина: 2-9)' FROM part
    UNION ALL SELECT p_partkey, 'level', 'Сгенерируй значение типа integer из списка: 1, 2, 3' FROM part
    UNION ALL SELECT p_partkey, 'price', 'Сгенерируй значение типа number (диапазон: 1-50) (паттерн: x)' FROM part
""")
def field_prompt_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand")
    ctx = F.create_map(
        F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")
    )
    return field_prompts(p.select("p_partkey", ctx.alias("ctx")), FIELD_SCHEMA).select("p_partkey", "field", "prompt")


def _attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents attached to the conversation their source number names."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return d.select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("conv_id"), "doc_id",
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("name"), "text",
    )


CHAT_SQL = r"""
files AS (
  SELECT CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) AS conv_id, doc_id,
    chr(10) || 'File: doc' || doc_id || '.' || lang || chr(10) || '```' || lang || chr(10)
      || CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || chr(10) || '... [truncated]' ELSE text END
      || chr(10) || '```' || chr(10) AS block
  FROM documents
), last AS (
  SELECT conv_id, max(turn) AS turn FROM conversations
  WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM files) GROUP BY conv_id
), parts AS (
  SELECT c.conv_id, c.turn, CAST(-1 AS BIGINT) AS part, c.role,
    c.text || CASE WHEN l.turn IS NOT NULL THEN chr(10) || chr(10) || '--- Attached Files ---' || chr(10) ELSE '' END AS text
  FROM conversations c LEFT JOIN last l ON l.conv_id = c.conv_id AND l.turn = c.turn
  UNION ALL
  SELECT f.conv_id, l.turn, f.doc_id, 'user', f.block FROM files f JOIN last l ON l.conv_id = f.conv_id
)
"""


@query("chat_assemble", f"WITH {CHAT_SQL} SELECT * FROM parts")
def chat_assemble(spark, sf_dir):
    messages = ordered_messages(table(spark, sf_dir, "conversations"))
    return chat.attach(messages, _attachments(spark, sf_dir), "doc_id")


@query("chat_requests", f"""
    WITH {CHAT_SQL}, b AS (SELECT *, sum(strlen(text) + 40) OVER (PARTITION BY conv_id) AS bytes FROM parts)
    SELECT conv_id, CAST(max(bytes) AS BIGINT) AS bytes, max(bytes) > 10485760 AS too_large,
      CASE WHEN max(bytes) <= 10485760 THEN CAST(count(DISTINCT turn) AS INTEGER) END AS messages,
      CASE WHEN max(bytes) <= 10485760 THEN string_agg(text, '' ORDER BY turn, part) END AS contents
    FROM b GROUP BY conv_id
""")
def chat_requests(spark, sf_dir):
    messages = ordered_messages(table(spark, sf_dir, "conversations"))
    bodies = chat.request_bodies(chat.attach(messages, _attachments(spark, sf_dir), "doc_id"))
    return bodies.select(
        "conv_id", "bytes", "too_large", F.array_size("messages").alias("messages"),
        F.array_join(F.transform("messages", lambda m: m["content"]), "").alias("contents"),
    )


@query("chat_images", r"""
    WITH pics AS (
      SELECT CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) AS conv_id, doc_id,
        'data:image/' || CASE doc_id % 15 WHEN 0 THEN 'png' ELSE 'jpeg' END || ';base64,' || base64(encode(text)) AS url
      FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL
    ), last AS (
      SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id
    ), shown AS (
      SELECT conv_id, turn, string_agg('{"type":"image_url","image_url":{"url":"' || url || '"}}', ',' ORDER BY doc_id) AS images
      FROM pics JOIN last USING (conv_id) GROUP BY 1, 2
    )
    SELECT c.conv_id, c.turn, role, CASE WHEN images IS NULL THEN '{"role":"' || role || '","content":' || to_json(text) || '}'
      ELSE '{"role":"user","content":[{"type":"text","text":' || to_json(text) || '},' || images || ']}' END AS message
    FROM conversations c LEFT JOIN shown s ON s.conv_id = c.conv_id AND s.turn = c.turn AND role = 'user'
""")
def chat_images(spark, sf_dir):
    """Every message as JSON; every fifth document is an image on the last user message of its conversation."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text").filter("doc_id % 5 = 0")
    ext = F.when(F.col("doc_id") % 15 == 0, ".png").when(F.col("doc_id") % 15 == 5, ".JPG").otherwise(".bmp")
    files = d.select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("conv_id"), "doc_id",
        F.concat(F.lit("pic"), F.col("doc_id").cast("string"), ext).alias("name"), F.col("text").cast("binary").alias("data"),
    )
    parts = ordered_messages(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.lit(-1).cast("bigint").alias("part"), "role", "text")
    return chat.message_json(parts, chat.image_urls(files), "doc_id")


def event_requests(events: DataFrame, *kept: str) -> DataFrame:
    """A request per event that asks about its type and value."""
    rows = events.select(
        "event_id", *kept, F.lit(system_prompt()).alias("system"),
        F.concat(F.lit("type="), F.col("event_type"), F.lit(" value="), F.col("value").cast("string")).alias("user"),
    )
    return with_request(rows, "m/one", identity=("event_id",)).select("event_id", "request_key", "request", *kept)


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers: every request but those of error events."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props").filter("event_type <> 'error'")
    return event_requests(e, "props").select("request_key", F.col("props").alias("content"))


@query("replay_join", """
    SELECT event_id, event_type <> 'error' AS success,
      CASE WHEN event_type <> 'error' THEN props END AS content,
      CASE WHEN event_type = 'error' THEN 'no recorded response' END AS error
    FROM events
""")
def replay_join(spark, sf_dir):
    asked = event_requests(table(spark, sf_dir, "events", "event_id", "event_type", "value"))
    return inference.replay(asked, _recorded(spark, sf_dir)).select("event_id", "success", "content", "error")


@query("resume_requests", "SELECT event_id FROM events WHERE event_type = 'error'")
def resume_requests(spark, sf_dir):
    asked = event_requests(table(spark, sf_dir, "events", "event_id", "event_type", "value"))
    return inference.remaining(asked, _recorded(spark, sf_dir)).select("event_id")


class EventCompleter:
    """Offline client for event requests.

    Errors are unavailable for good, signups hit the rate limit once, purchases
    time out, everything else is answered.
    """

    def complete(self, request: dict, attempt: int) -> dict:
        words = dict(part.split("=", 1) for part in request["messages"][1]["content"].split(" "))
        if words["type"] == "error":
            raise inference.CompletionError("Service temporarily unavailable.", status=503)
        if words["type"] == "signup" and attempt == 0:
            raise inference.CompletionError("Rate limit exceeded. Please wait and try again.", status=429)
        if words["type"] == "purchase":
            raise inference.CompletionError("Request timeout", code="TIMEOUT")
        content = json.dumps({"type": words["type"], "value": float(words["value"])})
        return {"content": content, "model": request["model"], "usage": {
            "prompt_tokens": len(request["messages"][1]["content"]), "completion_tokens": len(content),
        }}


def no_wait(_: float) -> None:
    return None


INFER_SQL = """
    SELECT event_id,
      CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS attempts,
      event_type NOT IN ('error', 'purchase') AS success,
      CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'purchase' THEN 'timeout' END AS error_class,
      CASE WHEN event_type NOT IN ('error', 'purchase') THEN event_type END AS answered,
      CASE WHEN event_type NOT IN ('error', 'purchase') THEN value END AS value
    FROM events
"""


def answers_view(answers: DataFrame) -> DataFrame:
    return with_json(answers, F.col("content"), "data").select(
        "event_id", "attempts", F.col("error").isNull().alias("success"),
        inference.error_class(F.col("status"), F.col("code")).alias("error_class"),
        F.try_variant_get("data", "$.type", "string").alias("answered"),
        F.try_variant_get("data", "$.value", "double").alias("value"),
    )


@query("infer_batch", INFER_SQL)
def infer_batch(spark, sf_dir):
    asked = event_requests(spread(table(spark, sf_dir, "events", "event_id", "event_type", "value")))
    answers = inference.complete_once(
        asked, EventCompleter, ["event_id", "request_key"], group_delay=0.0, base_delay=0.0, sleep=no_wait
    )
    return answers_view(answers)


@query("resume_run", INFER_SQL)
def resume_run(spark, sf_dir):
    """A run cancelled after its first chunk and then finished."""
    asked = event_requests(spread(table(spark, sf_dir, "events", "event_id", "event_type", "value")))
    path = scratch_path(spark, "resumed")
    options = {"group_delay": 0.0, "base_delay": 0.0, "sleep": no_wait}
    calls = iter([False, True])
    inference.complete_in_chunks(asked, EventCompleter, ["event_id", "request_key"], path, 3, lambda: next(calls), **options)
    inference.complete_in_chunks(asked, EventCompleter, ["event_id", "request_key"], path, 2, **options)
    return answers_view(inference.settled(spark.read.parquet(path)))


@query("error_class", """
    SELECT o_orderkey,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'auth' WHEN '2-HIGH' THEN 'rate_limit' WHEN '3-MEDIUM' THEN 'unavailable'
        WHEN '4-NOT SPECIFIED' THEN 'http' ELSE CASE o_orderstatus WHEN 'F' THEN 'timeout' WHEN 'O' THEN 'connection' ELSE 'other' END END AS kind,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Invalid API key.' WHEN '2-HIGH' THEN 'Rate limit exceeded. Please wait and try again.'
        WHEN '3-MEDIUM' THEN 'Service temporarily unavailable.'
        WHEN '4-NOT SPECIFIED' THEN 'API error (404): ' || CASE WHEN o_orderstatus = 'F' THEN 'Unknown error' ELSE o_orderstatus END
        ELSE CASE o_orderstatus WHEN 'F' THEN 'Request timeout'
          WHEN 'O' THEN 'Cannot connect to the service. Check your internet connection.' ELSE o_orderstatus END END AS message
    FROM orders
""")
def error_classes(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    status = F.when(p == "1-URGENT", 401).when(p == "2-HIGH", 429).when(p == "3-MEDIUM", 502).when(p == "4-NOT SPECIFIED", 404)
    code = F.when(p == "5-LOW", F.when(s == "F", "TIMEOUT").when(s == "O", "ECONNREFUSED").otherwise("CLIENT"))
    detail = F.when((p == "4-NOT SPECIFIED") & (s == "F"), "").otherwise(s)
    rows = o.withColumn("status", status).withColumn("code", code).withColumn("detail", detail)
    return rows.select(
        "o_orderkey", inference.error_class(F.col("status"), F.col("code")).alias("kind"),
        inference.error_message(F.col("status"), F.col("code"), F.col("detail")).alias("message"),
    )


@query("request_checks", """
    SELECT c_custkey, CASE WHEN c_nationkey < 5 OR c_acctbal < 0 THEN 'Model and messages are required' END AS problem,
      length(c_name || c_mktsegment) >= 20 AS usable_key FROM customer
""")
def request_checks(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    model = F.when(F.col("c_nationkey") < 5, "").otherwise("m/one")
    messages = F.when(F.col("c_acctbal") >= 0, F.array("c_name"))
    return c.select(
        "c_custkey", inference.request_problem(model, messages).alias("problem"),
        inference.usable_key(F.concat("c_name", "c_mktsegment")).alias("usable_key"),
    )


@query("run_status", """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'cancelled' WHEN o_orderpriority = '2-HIGH' THEN 'failed'
      WHEN o_orderstatus = 'O' THEN 'running' WHEN o_totalprice > 250000 THEN 'completed_with_errors' ELSE 'completed' END AS status
    FROM orders
""")
def run_statuses(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    p = F.col("o_orderpriority")
    errors = F.when(F.col("o_totalprice") > 250_000, 2).otherwise(0)
    return o.select("o_orderkey", inference.run_status(
        errors, p == "1-URGENT", p == "2-HIGH", F.col("o_orderstatus") != "O"
    ).alias("status"))


EXAMPLE_SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": "string", GENERATE: {"template": "item_{index}"}},
        "kind": {"type": "string", "enum": ["a", "b", "c"]},
        "title": {"type": "string", GENERATE: {"description": "A title"}},
        "count": {"type": "integer", "minimum": 2, "maximum": 9},
        "flag": {"type": "boolean"},
        "tags": {"type": "array", "items": {"type": "string"}},
        "inner": {"type": "object", "properties": {"x": {"type": "number"}}},
    },
    "required": ["id", "kind", "count", "tags", "inner"],
}


@query("example_rows", """
    SELECT c_custkey, '{"id": "item_{index}", "kind": "a", "title": "A title", "count": 2, "flag": true, "tags": ["example string"], "inner": {"x": 0}}' AS doc,
      true AS valid FROM customer
""")
def example_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer", "c_custkey").withColumn("doc", example_json(EXAMPLE_SCHEMA))
    checked = with_errors(with_json(rows, F.col("doc")), SchemaRules(EXAMPLE_SCHEMA))
    return checked.select("c_custkey", "doc", "valid")


@query("example_variants", """
    SELECT c_custkey, true AS valid, 'item_{index}' AS id, 'A title ' || c_custkey AS title, true AS in_limits FROM customer
""")
def example_variants(spark, sf_dir):
    rows = with_json(table(spark, sf_dir, "customer", "c_custkey"), varied_json(EXAMPLE_SCHEMA, F.col("c_custkey")))
    checked = with_errors(rows, SchemaRules(EXAMPLE_SCHEMA))
    return checked.select(
        "c_custkey", "valid", F.try_variant_get("item", "$.id", "string").alias("id"),
        F.try_variant_get("item", "$.title", "string").alias("title"),
        F.try_variant_get("item", "$.count", "int").between(2, 9).alias("in_limits"),
    )


@query("response_parse", r"""
    SELECT event_id,
      CASE event_type WHEN 'click' THEN replace(props, ' ', '') WHEN 'view' THEN replace(props, ' ', '')
        WHEN 'signup' THEN '[' || replace(props, ' ', '') || ',' || event_id || ']' END AS data,
      CASE WHEN event_type IN ('purchase', 'error') THEN 'Failed to parse JSON response' END AS error,
      CASE event_type WHEN 'purchase' THEN substr('Here: ' || substr(props, 1, length(props) - 1), 1, 200)
        WHEN 'error' THEN 'no json ' || event_id || ' ' || '}' END AS excerpt,
      CASE WHEN event_type = 'click' THEN true ELSE false END AS soft_wrapped
    FROM events
""")
def response_parse(spark, sf_dir):
    e = spread(table(spark, sf_dir, "events", "event_id", "event_type", "props"))
    kind, props = F.col("event_type"), F.col("props")
    number = F.col("event_id").cast("string")
    answer = (
        F.when(kind == "click", F.concat(F.lit("Sure {x}:\n```json\n"), props, F.lit("\n```\nBye {y}")))
        .when(kind == "view", F.concat(F.lit("Here you go: "), props, F.lit(" hope it helps")))
        .when(kind == "signup", F.concat(F.lit(" ["), props, F.lit(", "), number, F.lit("]\n")))
        .when(kind == "purchase", F.concat(F.lit("Here: "), F.substring(props, F.lit(1), F.char_length(props) - 1)))
        .otherwise(F.concat(F.lit("no json "), number, F.lit(" }")))
    )
    rows = with_answer(pin(e, answer=answer), "answer")
    soft = soft_parse(F.when(kind == "click", "plain words").otherwise(props), F.struct("event_id"))
    return rows.select(
        "event_id", F.to_json("data").alias("data"), F.col("parse_error").alias("error"), "excerpt",
        F.try_variant_get(child(soft, "content"), "$", "string").isNotNull().alias("soft_wrapped"),
    )


FILL_SCHEMA = {
    "type": "object",
    "properties": {
        "items": {"type": "array", "items": {"type": "object", "properties": {
            "id": {"type": "string", GENERATE: {"template": "{theme}_{index}_{name}"}},
            "name": {"type": "string"},
            "level": {"type": "integer", GENERATE: {"value": "{difficulty_num}"}},
        }}},
        "status": {"type": "string", GENERATE: {"mapping": {"F": "final", "O": 0}}},
        "absent": {"type": "string", GENERATE: {"value": "x"}},
    },
}


@query("post_process", """
    SELECT o_orderkey,
      '{"items":[{"id":"' || o_orderpriority || '_' || o_orderkey || '_n' || o_custkey || '","level":'
        || CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END || ',"name":"n' || o_custkey || '"},{"name":"two"}],"status":'
        || CASE o_orderstatus WHEN 'F' THEN '"final"' WHEN 'O' THEN '0' ELSE '"P"' END || '}' AS doc,
      '{"items":[{"id":"raw","level":9,"name":"n' || o_custkey || '"},{"name":"two"}],"status":'
        || CASE o_orderstatus WHEN 'F' THEN '"final"' ELSE '"' || o_orderstatus || '"' END || '}' AS compat_doc
    FROM orders
""")
def post_process(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    text = F.concat(
        F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('","items":[{"id":"raw","level":9,"name":"n'),
        F.col("o_custkey").cast("string"), F.lit('"},{"name":"two"}]}'),
    )
    level = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("3")
    ctx = F.create_map(
        F.lit("theme"), F.col("o_orderpriority"), F.lit("index"), F.col("o_orderkey").cast("string"),
        F.lit("difficulty_num"), level,
    )
    rows = with_json(o, text).withColumn("ctx", ctx)
    return rows.select(
        "o_orderkey", F.to_json(fill_fields(FILL_SCHEMA, F.col("item"), F.col("ctx"))).alias("doc"),
        F.to_json(fill_fields(FILL_SCHEMA, F.col("item"), F.col("ctx"), compat=True)).alias("compat_doc"),
    )


RUN_SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": "string", GENERATE: {"template": "{theme_translit}_{index}"}},
        "type": {"type": "string", "enum": ["click", "view", "signup"]},
        "value": {"type": "number", "maximum": 100},
    },
    "required": ["id", "type", "value"],
}


def generation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: tasks, items, requests, recorded answers, filled and checked items, documents and a ledger row per task key.

    Requests are written once and answered by their key; error events have no
    recorded answer.  Good items go to one document per task key, all results to a
    table, the totals to the ledger; what is returned is read back from them.
    """
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    task = F.to_json(F.struct(F.col("event_type").alias("theme"), F.col("user_id").alias("user"), F.col("value")))
    tasks = e.select("event_id", "event_type", "value", (F.col("event_id") % 2 + 1).alias("count"), task.alias("task_json"))
    items = with_context(with_fields(expand_items(tasks, ["event_id"])), NOW)
    items = items.withColumn("task_key", task_key(F.col("fields")))
    prompts = items.withColumn("system", F.lit(system_prompt())).withColumn(
        "user", structure_prompt(RUN_SCHEMA, F.col("ctx"), F.col("numeric"))
    )
    asked = with_request(prompts, "m/one", identity=("event_id", "index"))
    asked = materialize(asked.select("event_id", "index", "event_type", "value", "task_key", "ctx", "request_key", "request"), "requests")
    recorded = asked.filter("event_type <> 'error'").select("request_key", F.concat(
        F.lit('```json\n{"id":"?","type":"'), F.col("event_type"), F.lit('","value":'), F.col("value").cast("string"), F.lit("}\n```")
    ).alias("content"))
    answers = with_answer(inference.replay(asked, recorded), "content")
    filled = pin(answers, item=fill_fields(RUN_SCHEMA, F.col("data"), F.col("ctx")))
    checked = with_errors(filled, SchemaRules(RUN_SCHEMA))
    results = materialize(checked.select(
        "task_key", (F.col("event_id") * 2 + F.col("index")).alias("no"), "request_key", "item", "error", F.size("errors").alias("n_errors"),
        F.concat("event_type", F.lit("_"), F.col("index").cast("string")).alias("name"), (F.col("valid") & F.col("error").isNull()).alias("good"),
        F.char_length("request").cast("bigint").alias("prompt_tokens"), F.char_length("content").cast("bigint").alias("completion_tokens"),
    ), "results")

    documents, history = scratch_path(spark, "documents"), scratch_path(spark, "history")
    write_json_documents(results.filter("good"), documents, "task_key", "no", "item")
    spent = results.withColumn("cost", F.col("prompt_tokens") * 1e-6).withColumn("error", F.when(~F.col("good"), F.coalesce("error", F.lit("invalid"))))
    append_history(history_rows(run_totals(spent, "task_key"), NOW), history)

    lines = read_json_documents(spark, documents).groupBy("task_key").agg((F.count("*") - 2).alias("written"))
    booked = read_ledger(spark, history).select("task_key", F.col("items").alias("booked"), "status")
    counts = results.groupBy("task_key").agg(
        F.count("*").alias("items"), F.count_if("good").alias("valid"), F.count_if(F.col("error").isNotNull()).alias("unanswered"),
        F.sum("n_errors").cast("bigint").alias("errors"), F.count_distinct("request_key").alias("requests"),
        F.count_if(F.try_variant_get("item", "$.id", "string") == F.col("name")).alias("named"),
    )
    return counts.join(lines, "task_key", "left").join(booked, "task_key", "left")


@query("generation_run", """
    WITH i AS (SELECT event_type, value, unnest(range(event_id % 2 + 1)) AS "index" FROM events),
    c AS (SELECT *, event_type <> 'error' AS answered, event_type IN ('click', 'view', 'signup') AS known, value > 100 AS high FROM i)
    SELECT event_type || '_default' AS task_key, count(*) AS items, count(*) FILTER (answered AND known AND NOT high) AS valid,
      count(*) FILTER (NOT answered) AS unanswered, CAST(sum(CASE WHEN answered THEN CAST(NOT known AS INT) + CAST(high AS INT) ELSE 0 END) AS BIGINT) AS errors,
      count(*) AS requests, count(*) FILTER (answered) AS named,
      CASE WHEN count(*) FILTER (answered AND known AND NOT high) > 0 THEN count(*) FILTER (answered AND known AND NOT high) END AS written,
      count(*) FILTER (answered AND known AND NOT high) AS booked,
      CASE WHEN count(*) = count(*) FILTER (answered AND known AND NOT high) THEN 'completed' ELSE 'completed_with_errors' END AS status
    FROM c GROUP BY 1
""")
def generation_run_query(spark, sf_dir):
    return generation_run(spark, sf_dir)
