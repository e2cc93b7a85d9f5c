"""Queries for schema checks, coercion, schema corpora, column rules and error reports."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.formats import has_format
from quern.functions.pinned import pin
from quern.functions.variants import scalar_kind
from quern.operators import checks
from quern.operators.failures import error_rows, group_errors, top_groups
from quern.operators.reshape import coerce
from quern.operators.schema_fields import (
    corpus_fields, corpus_lint, corpus_references, fields_by_path, fields_of_type, generatable_fields, schema_overview,
)
from quern.operators.schema_rules import FORBIDDEN_PHRASE, GENERATE, SchemaRules
from quern.operators.validation import (
    attach_results, batch_summary, each_error, error_lines, invalid_report, split_batch, tag_invalid, with_errors,
)
from quern.plans.registry import query
from quern.plans.tables import event_props, table
from quern.session import materialize, spread
from quern.sources.readers import items_of, with_document, with_json

FLAT_SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": "integer"},
        "type": {"type": "string", "enum": ["click", "view", "purchase", "signup"]},
        "value": {"type": "number", "maximum": 100},
        "k": {"type": "integer", "maximum": 50, "multipleOf": 2},
        "user": {"type": "integer", "exclusiveMinimum": 10},
    },
    "required": ["id", "type", "k"],
    "additionalProperties": False,
}

FLAT_SQL = """
e AS (SELECT *, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events),
err AS (
  SELECT event_id, '/type' AS path, 'enum' AS keyword, 'should be one of: click, view, purchase, signup' AS message FROM e WHERE event_type = 'error'
  UNION ALL SELECT event_id, '/value', 'maximum', 'should be <= 100' FROM e WHERE value > 100
  UNION ALL SELECT event_id, '/k', 'maximum', 'should be <= 50' FROM e WHERE event_type <> 'signup' AND k > 50
  UNION ALL SELECT event_id, '/k', 'multipleOf', 'must be multiple of 2' FROM e WHERE event_type <> 'signup' AND k % 2 <> 0
  UNION ALL SELECT event_id, '/user', 'exclusiveMinimum', 'must be > 10' FROM e WHERE user_id <= 10
  UNION ALL SELECT event_id, '/', 'required', 'missing required property ''k''' FROM e WHERE event_type = 'signup'
  UNION ALL SELECT event_id, '/', 'additionalProperties', 'has unknown property ''extra''' FROM e WHERE event_type = 'error'
), per AS (SELECT event_id, count(*) AS n, min(path || ': ' || message) AS first FROM err GROUP BY 1)
"""


def event_documents(events: DataFrame) -> DataFrame:
    """Events as JSON documents; signups lack ``k``, errors carry one member too many."""
    text = F.to_json(F.struct(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("value"),
        F.when(F.col("event_type") != "signup", event_props()).alias("k"), F.col("user_id").alias("user"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("extra"),
    ))
    return with_json(events, text)


def checked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props"))
    return with_errors(event_documents(e), SchemaRules(FLAT_SCHEMA))


@query("validate_flat", f"WITH {FLAT_SQL} SELECT * FROM err")
def validate_flat(spark, sf_dir):
    return each_error(checked_events(spark, sf_dir), "event_id")


@query("batch_summary", f"""
    WITH {FLAT_SQL}
    SELECT event_type, count(*) AS total, count(*) FILTER (n IS NULL) AS valid, count(*) FILTER (n IS NOT NULL) AS invalid
    FROM e LEFT JOIN per USING (event_id) GROUP BY 1
""")
def summary(spark, sf_dir):
    return batch_summary(checked_events(spark, sf_dir), "event_type")


@query("split_batch", f"""
    WITH {FLAT_SQL}
    SELECT event_id, n IS NULL AS kept, coalesce(n, 0) AS n FROM e LEFT JOIN per USING (event_id)
""")
def split(spark, sf_dir):
    valid, invalid = split_batch(materialize(checked_events(spark, sf_dir).select("event_id", "errors", "valid"), "checked"))
    return valid.select("event_id", F.lit(True).alias("kept"), F.lit(0).cast("bigint").alias("n")).unionByName(
        invalid.select("event_id", F.lit(False).alias("kept"), F.size("errors").cast("bigint").alias("n"))
    )


TAG_SQL = f"""
    WITH {FLAT_SQL}
    SELECT event_id, CASE WHEN n IS NOT NULL THEN false END AS tag, CAST(n AS INTEGER) AS n, first
    FROM e LEFT JOIN per USING (event_id)
"""


def tag_view(tagged: DataFrame) -> DataFrame:
    lines = F.col("_validation.errors")
    return tagged.select(
        "event_id", F.col("_validation.valid").alias("tag"), F.array_size(lines).alias("n"), F.array_min(lines).alias("first")
    )


@query("tag_invalid", TAG_SQL)
def tag(spark, sf_dir):
    return tag_view(tag_invalid(checked_events(spark, sf_dir)))


@query("positional_join", f"""
    WITH {FLAT_SQL}
    SELECT e.event_id, event_type, CAST(n AS INTEGER) AS n FROM e LEFT JOIN per USING (event_id)
""")
def positional_join(spark, sf_dir):
    items = table(spark, sf_dir, "events", "event_id", "event_type")
    _, invalid = split_batch(checked_events(spark, sf_dir))
    return attach_results(items, invalid.select("event_id", F.size("errors").alias("n")), "event_id")


NESTED_SCHEMA = {
    "type": "object",
    "properties": {
        "order": {
            "type": "object",
            "properties": {
                "lines": {"type": "array", "minItems": 3, "maxItems": 3, "uniqueItems": True, "items": {
                    "type": "object",
                    "properties": {"name": {"type": "string"}, "v": {"type": "number", "maximum": 40}},
                    "required": ["name", "v"],
                }},
                "flag": {"type": "string", "pattern": "^[AN]$", "minLength": 1},
            },
            "required": ["lines"],
            "minProperties": 2,
        },
    },
    "required": ["order"],
}


@query("validate_nested", """
    WITH l AS (SELECT * FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, '/order/lines/0/v' AS path, 'maximum' AS keyword, 'should be <= 40' AS message FROM l WHERE l_quantity > 40
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, '/order/lines/1/v', 'type', 'should be array of number' FROM l WHERE l_linestatus = 'O'
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, '/order/lines/2', 'required', 'missing required property ''v''' FROM l WHERE l_tax = 0
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, '/order/flag', 'pattern', 'should match pattern "^[AN]$"' FROM l WHERE l_returnflag = 'R'
""")
def validate_nested(spark, sf_dir):
    li = spread(table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    ))
    number = F.col("l_discount").cast("string")
    second = F.when(F.col("l_linestatus") == "O", F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    third = F.when(F.col("l_tax") == 0, F.lit("")).otherwise(F.concat(F.lit(',"v":'), F.col("l_tax").cast("string")))
    text = F.concat(
        F.lit('{"order":{"lines":[{"name":"q","v":'), F.col("l_quantity").cast("string"), F.lit('},{"name":"d","v":'), second,
        F.lit('},{"name":"t"'), third, F.lit('}],"flag":"'), F.col("l_returnflag"), F.lit('"}}'),
    )
    checked = with_errors(with_json(li, text), SchemaRules(NESTED_SCHEMA))
    return each_error(checked, "l_orderkey", "l_linenumber", "l_partkey")


COMBINED_SCHEMA = {
    "type": "object",
    "properties": {
        "size": {"anyOf": [{"type": "integer", "maximum": 10}, {"type": "integer", "minimum": 40}]},
        "price": {"oneOf": [{"type": "number", "maximum": 960}, {"type": "number", "minimum": 940}]},
        "brand": {"allOf": [{"minLength": 8}, {"pattern": "1"}]},
        "kind": {"not": {"enum": ["PROMO", "SMALL"]}},
        "one": {"const": 1},
        "either": {"type": ["string", "null"]},
        "ref": {"$ref": "#/definitions/short", "maxLength": 9},
    },
    "definitions": {"short": {"type": "string", "maxLength": 5}},
}


@query("validate_combinators", """
    WITH e AS (
      SELECT p_partkey, '/size' AS path, unnest(['maximum', 'minimum', 'anyOf']) AS keyword,
        unnest(['should be <= 10', 'should be >= 40', 'must match a schema in anyOf']) AS message
      FROM part WHERE p_size > 10 AND p_size < 40
      UNION ALL SELECT p_partkey, '/price', 'oneOf', 'must match exactly one schema in oneOf' FROM part WHERE p_retailprice BETWEEN 940 AND 960
      UNION ALL SELECT p_partkey, '/brand', 'minLength', 'should have minimum length of 8' FROM part WHERE length(p_brand) < 8
      UNION ALL SELECT p_partkey, '/brand', 'pattern', 'should match pattern "1"' FROM part WHERE NOT contains(p_brand, '1')
      UNION ALL SELECT p_partkey, '/kind', 'not', 'must NOT be valid' FROM part WHERE p_type IN ('PROMO', 'SMALL')
      UNION ALL SELECT p_partkey, '/one', 'const', 'must be equal to constant' FROM part WHERE p_size <> 1
      UNION ALL SELECT p_partkey, '/either', 'type', 'should be string,null' FROM part WHERE p_type = 'LARGE'
      UNION ALL SELECT p_partkey, '/ref', 'maxLength', 'should have maximum length of 9' FROM part WHERE length(p_name) > 9
    )
    SELECT * FROM e
""")
def validate_combinators(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    either = F.when(F.col("p_type") == "LARGE", "7").when(F.col("p_type") == "MEDIUM", "null").otherwise('"x"')
    text = F.concat(
        F.lit('{"size":'), F.col("p_size").cast("string"), F.lit(',"price":'), F.col("p_retailprice").cast("string"),
        F.lit(',"brand":"'), F.col("p_brand"), F.lit('","kind":"'), F.col("p_type"), F.lit('","one":'),
        F.col("p_size").cast("double").cast("string"), F.lit(',"either":'), either, F.lit(',"ref":"'), F.col("p_name"), F.lit('"}'),
    )
    checked = with_errors(with_json(p, text), SchemaRules(COMBINED_SCHEMA))
    return each_error(checked, "p_partkey")


@query("validate_formats", r"""
    SELECT o_orderkey,
      CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE strftime(o_orderdate, '%d') = '28' END AS day_ok,
      o_orderstatus <> 'O' AS stamp_ok, o_orderstatus = 'F' AS clock_ok,
      o_orderpriority IN ('1-URGENT', '2-HIGH') AS mail_ok,
      o_orderstatus <> 'P' AS uuid_ok, o_custkey < 256 AS ip_ok
    FROM orders
""")
def validate_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    status = F.col("o_orderstatus")
    # Days past 28 of February do not exist; orders in status P get February with day 28 or a day past 29.
    dom = F.dayofmonth("o_orderdate")
    odd = F.concat(F.lit("2023-02-"), F.when(dom == 28, "28").otherwise("30"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = F.when(status == "F", day).when(status == "O", F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(odd)
    stamp = F.concat(day, F.when(status == "O", "").otherwise("T10:20:30Z"))
    clock = F.when(status == "F", "14:30:00Z").otherwise("24:00:00Z")
    mail = F.when(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com"))
    ).otherwise(F.concat(F.lit("c@"), F.col("o_custkey").cast("string")))
    tail = F.lpad(F.hex(F.col("o_orderkey")), 12, "0")
    uuid = F.concat(F.lit("123e4567-e89b-12d3-a456-"), F.when(status == "P", F.concat(tail, F.lit("0"))).otherwise(tail))
    ip = F.concat(F.lit("10.0.0."), F.col("o_custkey").cast("string"))
    tests = {"day_ok": (shown, "date"), "stamp_ok": (stamp, "date-time"), "clock_ok": (clock, "time"), "mail_ok": (mail, "email"),
             "uuid_ok": (uuid, "uuid"), "ip_ok": (ip, "ipv4")}
    return o.select("o_orderkey", *[has_format(text, name).alias(alias) for alias, (text, name) in tests.items()])


@query("validate_uris", r"""
    SELECT page_id, regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*:(?:[a-z0-9\-._~:/?@!$&''()*+,;=\[\]]|%[0-9a-f]{2})+(?:#(?:[a-z0-9\-._~:/?@!$&''()*+,;=\[\]]|%[0-9a-f]{2})*)?$') AS url_ok,
      false AS html_ok
    FROM pages
""")
def validate_uris(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return p.select("page_id", has_format(F.col("url"), "uri").alias("url_ok"), has_format(F.col("html"), "uri").alias("html_ok"))


DOCUMENT_SCHEMA = {
    "type": "object",
    "properties": {
        "lang": {"type": "string", "enum": ["en", "de", "fr", "es"]},
        "text": {"type": "string", GENERATE: {
            "minLength": 500, "maxLength": 5000, "requirements": ["kurz", f"{FORBIDDEN_PHRASE}ER THE"],
        }},
    },
}


@query("custom_rules", """
    SELECT doc_id, 'text: custom rule - minimum length should be 500' AS line FROM documents WHERE length(text) < 500
    UNION ALL SELECT doc_id, 'text: custom rule - maximum length should be 5000' FROM documents WHERE length(text) > 5000
    UNION ALL SELECT doc_id, 'text: should not contain "ER THE"' FROM documents WHERE contains(lower(text), 'er the')
""")
def custom_rules(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    checked = with_errors(with_json(d, F.to_json(F.struct("lang", "text"))).select("doc_id", "item"), SchemaRules(DOCUMENT_SCHEMA))
    return checked.select("doc_id", F.explode(error_lines(F.col("errors"))).alias("line"))


COERCE_SCHEMA = {
    "type": "object",
    "properties": {
        "k": {"type": "integer"},
        "flag": {"type": "boolean"},
        "label": {"type": "string"},
        "level": {"type": "integer", "default": 3},
        "amount": {"type": "number"},
    },
    "required": ["k", "flag"],
    "additionalProperties": False,
}


@query("coerce", """
    SELECT event_id,
      '{' || CASE WHEN event_type = 'error' THEN '"amount":"n/a",' ELSE '"amount":' || CASE event_type WHEN 'click' THEN '1' ELSE '2.5' END || ',' END
        || '"flag":' || CASE WHEN event_type IN ('click', 'view') THEN 'true' ELSE 'false' END
        || ',"k":' || (props::JSON->>'k') || ',"label":"' || user_id || '","level":3}' AS doc,
      event_type <> 'error' AS valid
    FROM events
""")
def coerce_events(spark, sf_dir):
    e = spread(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props"))
    kind = F.col("event_type")
    flag = F.when(kind == "click", '"true"').when(kind == "view", "1").when(kind == "purchase", "null").otherwise('"false"')
    amount = F.when(kind == "click", "true").when(kind == "error", '"n/a"').otherwise('"2.5"')
    text = F.concat(
        F.lit('{"k":"'), event_props().cast("string"), F.lit('","flag":'), flag, F.lit(',"label":'), F.col("user_id").cast("string"),
        F.lit(',"amount":'), amount, F.lit(',"extra":[1]}'),
    )
    rows = pin(with_json(e, text), item=coerce(COERCE_SCHEMA, F.col("item"))).select("event_id", "item")
    return with_errors(rows, SchemaRules(COERCE_SCHEMA)).select("event_id", F.to_json("item").alias("doc"), "valid")


ORDER_SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": ["string", "integer"]},
        "total": {"type": "number", "maximum": 450000},
        "priority": {"type": "string", "maxLength": 10},
    },
    "required": ["id"],
}


@query("validate_report", """
    WITH bad AS (
      SELECT o_orderkey, o_orderpriority,
        list_filter([CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '/priority: should have maximum length of 10' END,
          CASE WHEN o_totalprice > 450000 THEN '/total: should be <= 450000' END], lambda x: x IS NOT NULL) AS messages
      FROM orders
    )
    SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 'order 0' ELSE CAST(o_orderkey AS VARCHAR) END AS label,
      array_to_string(messages, '; ') AS messages
    FROM bad WHERE len(messages) > 0 ORDER BY o_orderkey LIMIT 10
""")
def validate_report(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderpriority"))
    text = F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"),
    ))
    checked = with_errors(with_json(o, text).select("o_orderkey", "item"), SchemaRules(ORDER_SCHEMA))
    report = invalid_report(checked, "item", "o_orderkey")
    return report.select("o_orderkey", "label", F.array_join("messages", "; ").alias("messages"))


@query("item_scan", """
    SELECT r_regionkey, o.o_custkey, CAST(i AS INTEGER) AS "index", CASE WHEN o.o_custkey % 2 = 0 THEN o.o_custkey + i ELSE o.o_custkey END AS id
    FROM (SELECT c_custkey AS o_custkey, c_nationkey FROM customer) o JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey,
      unnest(range(CASE WHEN o.o_custkey % 2 = 0 THEN 3 ELSE 1 END)) AS u(i)
""")
def item_scan(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    key = F.col("c_custkey")
    many = F.to_json(F.array(*[F.struct((key + i).alias("id")) for i in range(3)]))
    one = F.to_json(F.struct(key.alias("id")))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("r_regionkey"), key.alias("o_custkey"), F.when(key % 2 == 0, many).otherwise(one).alias("text")
    )
    return items_of(with_document(rows)).select(
        "r_regionkey", "o_custkey", "index", F.try_variant_get("item", "$.id", "bigint").alias("id")
    )


@query("numeric_range", """
    SELECT l_returnflag, count(*) FILTER (NOT l_discount BETWEEN 0.02 AND 0.08) AS outside, count(*) AS n FROM lineitem GROUP BY 1
""")
def numeric_range(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_discount")
    return li.groupBy("l_returnflag").agg(
        F.count_if(checks.outside_range(F.col("l_discount"), 0.02, 0.08)).alias("outside"), F.count("*").alias("n")
    )


# -- schemas as data ----------------------------------------------------------


def schema_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON Schema per part: limits, choices, references and types come from its columns."""
    p = spread(table(spark, sf_dir, "part"))
    size = F.col("p_size").cast("string")
    kind = F.when(F.col("p_type") == "PROMO", "text").otherwise("string")
    ref = F.when(F.col("p_type") == "LARGE", "#/definitions/gone").when(F.col("p_type") == "SMALL", "#/definitions/loop").otherwise("#/definitions/name")
    text = F.concat(
        F.lit('{"type":"object","required":["id","n"],"definitions":{"name":{"type":"string"},"loop":{"$ref":"#/definitions/loop"}},"properties":{'),
        F.lit('"id":{"type":"'), kind, F.lit('","maxLength":'), size, F.lit(',"description":"'), F.col("p_name"), F.lit('"},'),
        F.lit('"n":{"type":"integer","minimum":1,"maximum":'), size, F.lit('},'),
        F.lit('"list":{"type":"array","items":{"type":"string","enum":["'), F.col("p_brand"),
        F.lit(f'","x"],"{GENERATE}":{{"template":"t","description":"made"}}}}}},'),
        F.lit('"when":{"format":"date","anyOf":[{"type":"string"},{"type":"null"}]},'),
        F.lit(f'"gen":{{"{GENERATE}":{{"description":"made"}}}},'),
        F.lit('"r":{"$ref":"'), ref, F.lit('"}}}'),
    )
    return p.select("p_partkey", text.alias("doc"))


FIELDS_SQL = """
f AS (
  SELECT p_partkey, 0 AS field_no, 'id' AS path, CASE WHEN p_type = 'PROMO' THEN 'text' ELSE 'string' END AS type, NULL AS choices,
    '{"maxLength":"' || p_size || '"}' AS limits, false AS generatable FROM part
  UNION ALL SELECT p_partkey, 1, 'n', 'integer', NULL, '{"minimum":"1","maximum":"' || p_size || '"}', false FROM part
  UNION ALL SELECT p_partkey, 2, 'list.[]', 'string', p_brand || ',x', '{}', true FROM part
  UNION ALL SELECT p_partkey, 3, 'when.anyOf[0]', 'string', NULL, '{}', false FROM part
  UNION ALL SELECT p_partkey, 4, 'when.anyOf[1]', 'null', NULL, '{}', false FROM part
  UNION ALL SELECT p_partkey, 5, 'gen', NULL, NULL, '{}', true FROM part
)
"""


@query("schema_fields", f"WITH {FIELDS_SQL} SELECT * FROM f")
def schema_fields(spark, sf_dir):
    fields = corpus_fields(schema_corpus(spark, sf_dir), ["p_partkey"])
    return fields.select(
        "p_partkey", "field_no", "path", "type", F.array_join("enum", ",").alias("choices"),
        F.to_json("constraints").alias("limits"), F.col("settings").isNotNull().alias("generatable"),
    )


@query("field_queries", f"""
    WITH {FIELDS_SQL}
    SELECT p_partkey, 'when' AS question, path FROM f WHERE regexp_matches(path, 'w.*any')
    UNION ALL SELECT p_partkey, 'strings', path FROM f WHERE type = 'string'
    UNION ALL SELECT p_partkey, 'made', path FROM f WHERE generatable
    UNION ALL SELECT p_partkey, 'exact', path FROM f WHERE path = 'n'
""")
def field_queries(spark, sf_dir):
    # Written once: four questions would read every schema four times.
    fields = materialize(corpus_fields(schema_corpus(spark, sf_dir), ["p_partkey"]), "fields")
    asked = {
        "when": fields_by_path(fields, "w*any"), "strings": fields_of_type(fields, "string"),
        "made": generatable_fields(fields), "exact": fields.filter(F.col("path") == "n"),
    }
    out = None
    for name, rows in asked.items():
        part = rows.select("p_partkey", F.lit(name).alias("question"), "path")
        out = part if out is None else out.unionByName(part)
    return out


@query("schema_refs", """
    SELECT p_partkey, '/properties/r' AS place,
      CASE p_type WHEN 'LARGE' THEN '#/definitions/gone' WHEN 'SMALL' THEN '#/definitions/loop' ELSE '#/definitions/name' END AS ref,
      CASE p_type WHEN 'LARGE' THEN 'dangling' WHEN 'SMALL' THEN 'cyclic' ELSE 'ok' END AS state
    FROM part
    UNION ALL SELECT p_partkey, '/definitions/loop', '#/definitions/loop', 'cyclic' FROM part
""")
def schema_refs(spark, sf_dir):
    return corpus_references(schema_corpus(spark, sf_dir), ["p_partkey"])


@query("schema_lint", "SELECT p_partkey, 'properties.id.type' AS place FROM part WHERE p_type = 'PROMO'")
def schema_lint(spark, sf_dir):
    return corpus_lint(schema_corpus(spark, sf_dir), ["p_partkey"])


@query("schema_info", """
    SELECT p_partkey, 'object' AS schema_type, 'id' AS name, CASE WHEN p_type = 'PROMO' THEN 'text' ELSE 'string' END AS type, true AS required, p_name AS description FROM part
    UNION ALL SELECT p_partkey, 'object', 'n', 'integer', true, '' FROM part
    UNION ALL SELECT p_partkey, 'object', 'list', 'array', false, '' FROM part
    UNION ALL SELECT p_partkey, 'object', 'when', NULL, false, '' FROM part
    UNION ALL SELECT p_partkey, 'object', 'gen', NULL, false, 'made' FROM part
    UNION ALL SELECT p_partkey, 'object', 'r', NULL, false, '' FROM part
""")
def schema_info(spark, sf_dir):
    parsed = with_json(schema_corpus(spark, sf_dir), F.col("doc"), "schema")
    return schema_overview(parsed, ["p_partkey"])


# -- column rules ---------------------------------------------------------------


@query("rule_dsl", """
    SELECT c_custkey,
      CASE WHEN c_nationkey = 0 OR c_acctbal < 0 THEN 'Customer is missing required fields: '
        || concat_ws(', ', CASE WHEN c_nationkey = 0 THEN 'nation' END, CASE WHEN c_acctbal < 0 THEN 'balance' END) END AS required,
      concat_ws('; ',
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'Invalid value for segment: must be one of BUILDING, MACHINERY' END,
        CASE WHEN c_acctbal < 1 THEN 'score must be at least 1' WHEN c_acctbal > 9000 THEN 'score must be at most 9000' END,
        CASE WHEN length(c_mktsegment) < 9 THEN 'segment must be at least 9 characters'
          WHEN NOT regexp_matches(c_mktsegment, 'D$') THEN 'segment has invalid format' END,
        CASE WHEN c_nationkey > 12 THEN 'numbers[1]: Must be low' END) AS messages,
      CASE WHEN c_nationkey > 3 THEN 'Invalid type for nation: expected string, got number' END AS type_message
    FROM customer
""")
def rule_dsl(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    numbers = F.array(F.lit(1), F.col("c_nationkey"))
    messages = checks.object_messages({
        "segment": (F.col("c_mktsegment"), lambda v, n: checks.one_of(v, ["BUILDING", "MACHINERY"], n)),
        "score": (F.col("c_acctbal"), lambda v, n: checks.in_range(v, n, 1, 9000)),
    })
    more = checks.object_messages({
        "segment": (F.col("c_mktsegment"), lambda v, n: checks.text_rule(v, n, low=9, pattern="D$")),
        "numbers": (numbers, lambda v, n: checks.list_rule(v, n, low=1, high=5, item=lambda e: F.when(e > 12, "Must be low"))),
    })
    value = F.when(F.col("c_nationkey") > 3, "7").otherwise('"x"')
    return c.select(
        "c_custkey",
        checks.required({
            "nation": F.col("c_nationkey"), "balance": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")),
        }, "Customer").alias("required"),
        F.array_join(F.concat(messages, more), "; ").alias("messages"),
        checks.of_type(scalar_kind(F.parse_json(value)), "string", "nation").alias("type_message"),
    )


# -- error groups -----------------------------------------------------------------

LINE_SCHEMA = {
    "type": "object",
    "properties": {
        "quantity": {"type": "number", "maximum": 45},
        "discount": {"type": "number", "maximum": 0.08},
        "flag": {"type": "string", "enum": ["A", "N"]},
        "status": {"type": "string", "enum": ["F"]},
    },
}


def checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    li = spread(table(spark, sf_dir, "lineitem", *columns))
    text = F.to_json(F.struct(
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    ))
    rows = with_json(li, text).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"), "item")
    return with_errors(rows, SchemaRules(LINE_SCHEMA))


def line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows of all order lines, checked once and written."""
    return materialize(error_rows(checked_lines(spark, sf_dir), "index"), "line-errors")


GROUPS_SQL = """
e AS (
  SELECT l_orderkey * 10 + l_linenumber AS item, 'quantity' AS field, 'should be <= 45' AS message FROM lineitem WHERE l_quantity > 45
  UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'discount', 'should be <= 0.08' FROM lineitem WHERE l_discount > 0.08
  UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'flag', 'should be one of: A, N' FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'status', 'should be one of: F' FROM lineitem WHERE l_linestatus <> 'F'
), g AS (
  SELECT field, message, count(*) AS n, array_to_string(list(item ORDER BY item)[1:3], ', ') AS shown FROM e GROUP BY 1, 2
)
"""


@query("error_groups", f"""
    WITH {GROUPS_SQL}
    SELECT field, message, n, field || ': ' || message || ' (items: ' || shown
      || CASE WHEN n > 3 THEN ', ... and ' || (n - 3) || ' more' ELSE '' END || ')' AS text
    FROM g
""")
def error_groups(spark, sf_dir):
    groups = group_errors(line_errors(spark, sf_dir))
    return groups.select("field", "message", "n", "text")


@query("top_error_groups", f"WITH {GROUPS_SQL} SELECT field, message, n FROM g ORDER BY n DESC, field, message LIMIT 10")
def top_error_groups(spark, sf_dir):
    groups = group_errors(line_errors(spark, sf_dir))
    return top_groups(groups).select("field", "message", "n")


KEYWORDS_SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": "integer"}, "status": {"type": "string"}, "price": {"type": "number"}, "clerk": {"type": "string"}, "note": {"type": "string"},
        "codes": {"type": "array", "contains": {"const": 0}},
        "pair": {"type": "array", "items": [{"type": "integer"}, {"type": "string"}], "additionalItems": False},
        "memo": {"type": "string", "nullable": True},
    },
    "patternProperties": {"^x_": {"maximum": 7}, "_n$": {"type": "integer"}},
    "additionalProperties": False,
    "propertyNames": {"maxLength": 8},
    "dependencies": {"clerk": ["note"]},
    "if": {"properties": {"status": {"const": "P"}}},
    "then": {"required": ["clerk"]},
    "else": {"properties": {"price": {"maximum": 400000}}},
}


@query("validate_keywords", """
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p FROM orders)
    SELECT k, '/' AS path, 'additionalProperties' AS keyword, 'has unknown property ''stray''' AS message FROM o WHERE k % 17 = 0
    UNION ALL SELECT k, '/', 'maxLength', 'should have maximum length of 8' FROM o WHERE k % 11 = 0
    UNION ALL SELECT k, '/', 'propertyNames', 'property name must be valid' FROM o WHERE k % 11 = 0
    UNION ALL SELECT k, '/', 'dependencies', 'must have property note when property clerk is present' FROM o WHERE k % 10 = 5
    UNION ALL SELECT k, '/', 'required', 'missing required property ''clerk''' FROM o WHERE s = 'P' AND k % 5 <> 0
    UNION ALL SELECT k, '/', 'if', 'must match "then" schema' FROM o WHERE s = 'P' AND k % 5 <> 0
    UNION ALL SELECT k, '/price', 'maximum', 'should be <= 400000' FROM o WHERE s <> 'P' AND p > 400000
    UNION ALL SELECT k, '/', 'if', 'must match "else" schema' FROM o WHERE s <> 'P' AND p > 400000
    UNION ALL SELECT k, '/codes', 'contains', 'must contain at least 1 valid item(s)' FROM o WHERE c % 7 <> 0 AND c % 5 <> 0
    UNION ALL SELECT k, '/codes/' || i, 'const', 'must be equal to constant' FROM o, unnest([0, 1]) AS u(i) WHERE c % 7 <> 0 AND c % 5 <> 0
    UNION ALL SELECT k, '/pair', 'additionalItems', 'must NOT have more than 2 items' FROM o WHERE k % 3 = 0
    UNION ALL SELECT k, '/x_n', 'maximum', 'should be <= 7' FROM o WHERE c % 10 > 7
    UNION ALL SELECT k, '/memo', 'type', 'should be string' FROM o WHERE k % 13 = 0
""")
def validate_keywords(spark, sf_dir):
    """Conditions, containment, patterns, names, dependencies and list tails; rows that break each of them."""
    o = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    k, c, text = F.col("o_orderkey"), F.col("o_custkey"), lambda x: x.cast("string")
    doc = F.concat(
        F.lit('{"id":'), text(k), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('","price":'), text(F.col("o_totalprice")),
        F.when(k % 5 == 0, ',"clerk":"c"').otherwise(""), F.when(k % 10 == 0, ',"note":"n"').otherwise(""),
        F.lit(',"codes":['), text(c % 7), F.lit(","), text(c % 5), F.lit('],"pair":['), text(k), F.lit(',"a"'), F.when(k % 3 == 0, ",1").otherwise(""),
        F.lit('],"x_n":'), text(c % 10), F.when(k % 11 == 0, ',"long_name_n":1').otherwise(""), F.when(k % 17 == 0, ',"stray":1').otherwise(""),
        F.when(k % 13 == 0, ',"memo":5').when(k % 4 == 0, ',"memo":null').otherwise(',"memo":"m"'), F.lit("}"),
    )
    return each_error(with_errors(with_json(o, doc), SchemaRules(KEYWORDS_SCHEMA)), k.alias("k"))


TREE_SCHEMA = {
    "type": "object",
    "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#"}}},
    "required": ["v"],
    "additionalProperties": False,
}


@query("validate_recursive", """
    SELECT c_custkey, repeat('/kids/0', CAST(c_custkey % 71 - i AS INTEGER)) || '/v' AS path, 'type' AS keyword, 'should be integer' AS message
    FROM (SELECT c_custkey, unnest(range(1, c_custkey % 71 + 1)) AS i FROM customer) WHERE (c_custkey + i) % 17 = 0
""")
def validate_recursive(spark, sf_dir):
    """Trees up to 71 levels deep against a schema that refers to itself."""
    c = spread(table(spark, sf_dir, "customer", "c_custkey"))
    key = F.col("c_custkey")
    levels = F.filter(F.sequence(F.lit(0).cast("bigint"), key % 71), lambda i: i > 0)
    wrap = lambda inner, i: F.concat(
        F.lit('{"v":'), F.when((key + i) % 17 == 0, '"s"').otherwise(i.cast("string")), F.lit(',"kids":['), inner, F.lit("]}")
    )
    doc = F.aggregate(levels, F.lit('{"v":0}'), wrap)
    return each_error(with_errors(with_json(c, doc), SchemaRules(TREE_SCHEMA)), "c_custkey")
