"""Queries over configurations: scan, overview, audit, merge, options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.pinned import pin
from quern.operators import configs
from quern.operators.merging import merge_documents
from quern.plans.registry import query
from quern.plans.tables import table
from quern.session import scratch_path, spread
from quern.sources.readers import read_documents, with_document, with_json


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration text per customer; segments and nations decide what is wrong with it."""
    c = spread(table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    nation = F.col("c_nationkey")
    heat = F.when(nation < 5, "2.5").when(nation < 10, '"hot"').otherwise("0.5")
    limit = F.when(nation > 20, "-100").otherwise("800")
    model = F.when(nation == 12, "").otherwise(F.concat(F.lit('"model":"m/'), nation.cast("string"), F.lit('",')))
    schema = (
        F.when(F.col("c_mktsegment") == "BUILDING", "{}")
        .when(F.col("c_mktsegment") == "MACHINERY", "")
        .otherwise('{"type":"object","properties":{"items":{"type":"array","items":{"properties":{"a":{},"b":{},"c":{}}}},"x":{}}}')
    )
    text = F.concat(
        F.lit('{"meta":{"name":"'), F.col("c_name"), F.lit('"},"api":{'), model, F.lit('"temperature":'), heat, F.lit(',"maxTokens":'), limit,
        F.lit('},"output":{"format":"'), F.when(nation == 15, "text").otherwise("json"), F.lit('"}'),
        F.when(schema != "", F.concat(F.lit(',"schema":'), schema)).otherwise(""),
        F.when(nation >= 10, ',"generation":{"tasks":[{"count":2},{"count":3}]}').otherwise(""),
        F.when(nation == 24, "").otherwise("}"),
    )
    return c.select("c_custkey", text.alias("text"))


@query("config_audit", """
    SELECT c_custkey, c_nationkey <> 24 AS parse_ok,
      CASE WHEN c_nationkey <> 24 THEN concat_ws('; ',
        CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey <> 15 THEN 'Config is missing required fields: schema' END,
        CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey <> 15 THEN 'Schema must have a type property' END,
        CASE WHEN c_nationkey < 10 THEN 'Temperature must be a number between 0 and 2' END,
        CASE WHEN c_nationkey > 20 THEN 'maxTokens must be a positive number' END) END AS problems,
      CASE WHEN c_nationkey <> 24 THEN c_nationkey <> 12 AND (c_mktsegment <> 'MACHINERY' OR c_nationkey >= 10) END AS runnable
    FROM customer
""")
def config_audit(spark, sf_dir):
    rows = with_document(_texts(spark, sf_dir))
    good = F.col("parse_ok")
    return rows.select(
        "c_custkey", "parse_ok", F.when(good, F.array_join(configs.problems(F.col("doc")), "; ")).alias("problems"),
        F.when(good, configs.is_runnable(F.col("doc"))).alias("runnable"),
    )


@query("config_overview", """
    SELECT c_custkey, CASE WHEN bad THEN 'Unnamed' ELSE c_name END AS name, '1.0' AS version,
      CASE WHEN bad OR c_nationkey = 12 THEN 'default' ELSE 'm/' || c_nationkey END AS model,
      CASE WHEN NOT bad AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'object' ELSE 'unknown' END AS schema_type,
      CASE WHEN NOT bad AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 0 END AS properties_count,
      CASE WHEN NOT bad AND c_nationkey >= 10 THEN 2 ELSE 0 END AS tasks_count, 'none' AS output_path,
      CASE WHEN bad THEN 4000e0 WHEN c_nationkey > 20 THEN -100e0 ELSE 800e0 END AS max_tokens,
      CASE WHEN bad THEN 0.7e0 WHEN c_nationkey < 5 THEN 2.5e0 WHEN c_nationkey < 10 THEN 0.7e0 ELSE 0.5e0 END AS temperature,
      CASE WHEN NOT bad AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 3 ELSE 0 END AS field_count
    FROM (SELECT *, c_nationkey = 24 AS bad FROM customer)
""")
def config_overview(spark, sf_dir):
    rows = with_document(_texts(spark, sf_dir))
    columns = [c.alias(n) for n, c in configs.overview(F.col("doc")).items()]
    return rows.select("c_custkey", *columns, configs.field_count(F.col("doc")).alias("field_count"))


@query("config_scan", """
    SELECT r_regionkey, 'r' || r_regionkey || '.json' AS file, r_regionkey <> 2 AS parse_ok, n AS configs
    FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ON n_regionkey = r_regionkey
""")
def config_scan(spark, sf_dir):
    """One configuration file per region, written and scanned; the third is cut short."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    sizes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("configs"))
    key = F.col("n_regionkey").cast("string")
    text = F.concat(
        F.lit('{"region":'), key, F.lit(',"configs":'), F.col("configs").cast("string"), F.when(F.col("n_regionkey") == 2, "").otherwise("}")
    )
    path = scratch_path(spark, "configs")
    sizes.select(text.alias("value"), F.concat(F.lit("r"), key, F.lit(".json")).alias("file")).write.partitionBy("file").text(path)
    found = read_documents(spark, path, "*.txt")
    return found.select(
        F.regexp_extract("text", r'"region":(\d+)', 1).cast("int").alias("r_regionkey"),
        F.regexp_extract("path", "file=([^/]+)", 1).alias("file"), "parse_ok",
        F.regexp_extract("text", r'"configs":(\d+)', 1).cast("bigint").alias("configs"),
    )


@query("config_merge", """
    SELECT o_orderkey,
      '{"api":{"maxTokens":100,"model":"' || CASE WHEN o_orderstatus = 'F' THEN 'm/base' ELSE 'm/' || o_orderpriority END || '","temperature":0.5},'
        || '"list":' || CASE WHEN o_orderstatus = 'O' THEN '[9]' ELSE '[1,2,3]' END
        || ',"output":{"path":' || CASE o_orderstatus WHEN 'P' THEN '{"deep":{"x":' || o_custkey || ',"y":2}}' ELSE '{"deep":{"x":1,"y":2}}' END || '}'
        || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ',"schema":{"type":"' || o_orderstatus || '"}' END || '}' AS doc,
      '{"api":{"maxTokens":5,"model":"cli","temperature":0.5},"generation":{"tasks":[{"count":7,"theme":"' || o_orderpriority || '"},{"count":1}]},"output":{"outputPath":"out"}}' AS with_options
    FROM orders
""")
def config_merge(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    status = F.col("o_orderstatus")
    base = F.lit('{"api":{"model":"m/base","temperature":0.5,"maxTokens":100},"list":[1,2,3],"output":{"path":{"deep":{"x":1,"y":2}}}}')
    model = F.concat(F.lit('"api":{"model":"m/'), F.col("o_orderpriority"), F.lit('"},"schema":{"type":"'), status, F.lit('"}'))
    over = (
        F.when(status == "F", "{}")
        .when(status == "O", F.concat(F.lit("{"), model, F.lit(',"list":[9]}')))
        .otherwise(F.concat(F.lit("{"), model, F.lit(',"output":{"path":{"deep":{"x":'), F.col("o_custkey").cast("string"), F.lit("}}}}")))
    )
    plan = F.concat(
        F.lit('{"api":{"model":"m","temperature":0.5},"generation":{"tasks":[{"theme":"'), F.col("o_orderpriority"), F.lit('"},{"count":1}]}}')
    )
    rows = with_json(with_json(with_json(o, base, "base"), over, "over"), plan, "plan")
    merged = pin(rows, merged=configs.merge(F.col("base"), F.col("over"), 8))
    options = {"model": "cli", "max_tokens": 5, "output": "out", "count": 7}
    return merged.select(
        "o_orderkey", F.to_json("merged").alias("doc"), F.to_json(configs.with_options(F.col("plan"), options)).alias("with_options")
    )


@query("config_merge_deep", """
    SELECT c_custkey, repeat('{"b":1,"o":2,"x":', CAST(c_custkey % 201 AS INTEGER)) || '{"a":' || c_nationkey || ',"m":{"q":1,"z":2}}'
      || repeat('}', CAST(c_custkey % 201 AS INTEGER)) AS doc FROM customer
""")
def config_merge_deep(spark, sf_dir):
    """Documents up to 202 objects deep on both sides."""
    c = spread(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"))
    n = (F.col("c_custkey") % 201).cast("int")
    nested = lambda head, inner: F.concat(F.repeat(F.lit(head), n), inner, F.repeat(F.lit("}"), n))
    base = nested('{"b":1,"x":', F.lit('{"a":0,"m":{"q":1}}'))
    over = nested('{"o":2,"x":', F.concat(F.lit('{"a":'), F.col("c_nationkey").cast("string"), F.lit(',"m":{"z":2}}')))
    rows = with_json(with_json(c, base, "base"), over, "over")
    return merge_documents(rows, "base", "over").select("c_custkey", F.to_json("merged").alias("doc"))
