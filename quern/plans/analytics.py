"""Queries over the run ledger: costs, totals, progress, users, sessions, storage, metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.display import (
    bytes_text, bytes_text_trimmed, cost_text, duration_text, progress_text, relative_time, status_label,
)
from quern.operators import ledger
from quern.operators.catalog import search_price_per_thousand
from quern.operators.running import sessions, top_per_key
from quern.plans.registry import query
from quern.plans.tables import MODELS_SQL, event_props, models, requests, table
from quern.session import materialize, scratch_path
from quern.sources.readers import read_ledger
from quern.sources.writers import append_history

NOW = datetime(2024, 1, 31, 0, 0, 0)
HISTORY_NOW = datetime(2001, 8, 2, 0, 0, 0)


@query("request_cost", f"""
    WITH {MODELS_SQL}
    SELECT id AS model_id, count(*) AS requests,
      round(sum(CASE WHEN l_returnflag = 'A' THEN 0.001e0 + 0.002e0
        ELSE CAST(l_quantity AS BIGINT) * prompt + CAST(l_quantity * l_linenumber AS BIGINT) * completion END), 9) AS split_cost,
      round(sum(CASE WHEN l_returnflag = 'A' THEN 0.001e0 + 0.002e0
        ELSE (CAST(l_quantity AS BIGINT) + CAST(l_quantity * l_linenumber AS BIGINT)) * prompt END), 9) AS prompt_only_cost
    FROM lineitem LEFT JOIN models ON l_partkey = p_partkey GROUP BY 1
""")
def request_cost(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_linenumber", "l_returnflag")
    own = F.col("l_returnflag") == "A"
    asked = li.select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("bigint").alias("prompt_tokens"),
        (F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("completion_tokens"),
        F.when(own, F.lit(0.001)).alias("prompt_cost"), F.when(own, F.lit(0.002)).alias("completion_cost"),
    )
    priced = models(spark, sf_dir, "p_partkey")
    rows = asked.join(priced.select("p_partkey", F.col("id").alias("model_id"), "prompt", "completion"), "p_partkey", "left")
    return rows.groupBy("model_id").agg(
        F.count("*").alias("requests"),
        F.round(F.sum(ledger.request_cost()), 9).alias("split_cost"),
        F.round(F.sum(ledger.request_cost(split=False)), 9).alias("prompt_only_cost"),
    )


TOTALS_SQL = """
t AS (
  SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag <> 'R') AS items, count(*) FILTER (l_returnflag = 'R') AS errors,
    CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'R'), 0) AS BIGINT) AS prompt_tokens,
    CAST(coalesce(sum(CAST(l_quantity * l_linenumber AS BIGINT)) FILTER (l_returnflag <> 'R'), 0) AS BIGINT) AS completion_tokens,
    coalesce(sum(l_extendedprice * (1 - l_discount)) FILTER (l_returnflag <> 'R'), 0) AS cost
  FROM lineitem GROUP BY 1
)
"""


@query("run_totals", f"""
    WITH {TOTALS_SQL}
    SELECT run_id, items, errors, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens,
      round(cost, 4) AS cost,
      CAST(floor((prompt_tokens + completion_tokens) / greatest(items, 1) + 0.5) AS BIGINT) AS avg_tokens,
      CASE WHEN errors > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status
    FROM t
""")
def run_totals(spark, sf_dir):
    totals = ledger.run_totals(requests(spark, sf_dir), "run_id")
    return totals.withColumn("cost", F.round("cost", 4)).drop("avg_cost")


@query("ledger_append", f"""
    WITH {TOTALS_SQL}
    SELECT status, count(*) AS runs, CAST(sum(items) AS BIGINT) AS items, max(completed_at) AS completed_at,
      CAST(sum(requests) AS BIGINT) AS requests FROM (
      SELECT items, items + errors AS requests, CASE WHEN errors > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, '2024-01-31' AS completed_at FROM t
    ) GROUP BY 1
""")
def ledger_append(spark, sf_dir):
    path = scratch_path(spark, "history")
    rows = materialize(ledger.history_rows(ledger.run_totals(requests(spark, sf_dir), "run_id"), NOW), "totals")
    append_history(rows.filter("errors = 0"), path)
    append_history(rows.filter("errors > 0"), path)
    return read_ledger(spark, path).groupBy("status").agg(
        F.count("*").alias("runs"), F.sum("items").alias("items"), F.max(F.date_format("completed_at", "yyyy-MM-dd")).alias("completed_at"),
        F.sum(F.try_variant_get("metadata", "$.requests", "bigint")).alias("requests"),
    )


@query("ledger_rows", f"""
    WITH {TOTALS_SQL},
    f AS (SELECT l_orderkey AS run_id, l_linenumber % 3 AS m, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
    e AS (SELECT run_id, '[' || string_agg('{{"message":"line ' || m || '","count":' || n || '}}', ',' ORDER BY m) || ']' AS errors FROM f GROUP BY 1),
    d AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber % 2 AS p FROM lineitem WHERE l_returnflag <> 'R'),
    w AS (SELECT run_id, '[' || string_agg('"out/' || run_id || '_' || p || '.json"', ',' ORDER BY p) || ']' AS output_files FROM d GROUP BY 1)
    SELECT run_id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'Unnamed config' ELSE o_orderpriority END AS config_name,
      CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'm/' || o_orderstatus END AS model,
      CASE WHEN t.errors > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, items AS items_generated, round(cost, 4) AS total_cost,
      prompt_tokens + completion_tokens AS total_tokens, prompt_tokens, completion_tokens, e.errors, output_files,
      '{{"duration":' || run_id % 1000 * 1000 || ',"format":"json","tasks":' || (run_id % 3 + 1) || '}}' AS metadata,
      strftime(o_orderdate + to_seconds(run_id % 1000), '%Y-%m-%d %H:%M:%S') AS completed_at
    FROM t JOIN orders ON o_orderkey = run_id LEFT JOIN e USING (run_id) LEFT JOIN w USING (run_id)
""")
def ledger_rows(spark, sf_dir):
    """The whole row of every run, written to the ledger and read back."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    start = F.col("o_orderdate").cast("timestamp")
    runs = o.select(
        key.alias("run_id"), F.col("o_custkey").alias("user_id"), F.when(status != "F", F.col("o_orderpriority")).alias("config_name"),
        F.when(status == "P", "").otherwise(F.concat(F.lit("m/"), status)).alias("model"), F.lit("json").alias("format"), (key % 3 + 1).alias("tasks"),
        start.alias("started_at"), F.timestamp_seconds(F.unix_seconds(start) + key % 1000).alias("finished_at"),
    )
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumnRenamed("l_orderkey", "run_id")
    line = F.col("l_linenumber")
    errors = li.filter("l_returnflag = 'R'").select("run_id", F.concat(F.lit("line "), (line % 3).cast("string")).alias("message"))
    files = li.filter("l_returnflag <> 'R'").select("run_id", F.concat(F.lit("out/"), F.col("run_id").cast("string"), F.lit("_"), (line % 2).cast("string"), F.lit(".json")).alias("path"))
    path = scratch_path(spark, "ledger")
    append_history(ledger.ledger_rows(ledger.run_totals(requests(spark, sf_dir), "run_id"), runs, errors, files), path)
    rows = spark.read.parquet(path)
    return rows.withColumn("total_cost", F.round("total_cost", 4)).withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"))


@query("estimate_difference", f"""
    WITH {TOTALS_SQL}
    SELECT run_id, CASE WHEN items = 0 THEN NULL ELSE round((cost - items * 30011e0) / (items * 30011e0) * 100, 4) END AS percent FROM t
""")
def estimate_difference(spark, sf_dir):
    totals = ledger.run_totals(requests(spark, sf_dir), "run_id")
    return totals.select("run_id", F.round(ledger.estimate_difference(F.col("cost"), F.col("items") * 30011.0), 4).alias("percent"))


@query("cost_estimate", f"""
    WITH {MODELS_SQL}
    SELECT p_partkey, round((prompt * 1e6) * (25e0 * max_completion_tokens / 1000000), 9) AS max_cost,
      round(25 * 500 * prompt, 9) AS prompt_cost, round(25 * max_completion_tokens * completion, 9) AS completion_cost,
      round(25 / 1000e0 * CASE WHEN native THEN 8e0 ELSE 20e0 END, 9) AS search_cost
    FROM models
""")
def cost_estimate(spark, sf_dir):
    m = models(spark, sf_dir, "p_partkey")
    parts = ledger.detailed_estimate(
        F.lit(25), F.col("max_completion_tokens"), F.col("prompt"), F.col("completion"), search_price_per_thousand()
    )
    rows = m.withColumn("e", parts)
    top = ledger.max_cost_estimate(F.lit(25.0), F.col("max_completion_tokens"), F.col("prompt") * 1e6)
    return rows.select(
        "p_partkey", F.round(top, 9).alias("max_cost"), F.round("e.prompt", 9).alias("prompt_cost"),
        F.round("e.completion", 9).alias("completion_cost"), F.round("e.web_search", 9).alias("search_cost"),
    )


@query("progress", """
    WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS good, CAST(props::JSON->>'k' AS BIGINT) AS k, value,
        count(*) OVER (PARTITION BY user_id) AS total FROM events)
    SELECT user_id, event_id, total, current, tokens_so_far, round(cost_so_far, 2) AS cost_so_far,
      CAST(floor(current / total * 100 + 0.5) AS BIGINT) AS percent
    FROM (
      SELECT user_id, event_id, total,
        CAST(count(*) FILTER (good) OVER w AS BIGINT) AS current,
        CAST(coalesce(sum(k + 1) FILTER (good) OVER w, 0) AS BIGINT) AS tokens_so_far,
        coalesce(sum(value) FILTER (good) OVER w, 0) AS cost_so_far
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    )
""")
def progress(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props")
    rows = e.select(
        "user_id", "event_id", event_props().alias("prompt_tokens"), F.lit(1).alias("completion_tokens"),
        F.col("value").alias("cost"), F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    out = ledger.progress(rows, "user_id", "event_id")
    return out.select(
        "user_id", "event_id", "total", "current", "tokens_so_far", F.round("cost_so_far", 2).alias("cost_so_far"), "percent"
    )


@query("history_top", """
    SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rank,
      CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Completed with errors' ELSE 'P' END AS label
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY row_number() OVER w <= 5
""")
def history_top(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "completed_with_errors").otherwise("P")
    latest = ledger.latest_runs(o, "o_custkey", "o_orderdate", "o_orderkey", n=5)
    return latest.select("o_custkey", "o_orderkey", "rank", status_label(status).alias("label"))


@query("history_page", """
    SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
""")
def history_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(ledger.HISTORY_PAGE).select("o_orderkey", "o_custkey")


@query("last_write", """
    SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2
""")
def last_write(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value")
    return ledger.last_write(e, ["user_id", "event_type"], ["event_id"], ["value"])


@query("queue_union", """
    SELECT o_orderkey, 'active' AS kind, o_totalprice AS total, NULL AS label FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, 'completed', NULL, o_orderpriority FROM orders WHERE o_orderstatus <> 'O'
""")
def queue_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    active = o.filter("o_orderstatus = 'O'").select("o_orderkey", F.col("o_totalprice").alias("total"))
    done = o.filter("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return ledger.queue_view(active, done)


@query("insert_ignore", """
    WITH n AS (SELECT o_custkey + 1 AS key, min(o_orderkey) AS source, arg_min(o_orderpriority, o_orderkey) AS note FROM orders GROUP BY 1)
    SELECT c_custkey AS key, CAST(NULL AS BIGINT) AS source, c_name AS note FROM customer
    UNION ALL SELECT key, source, note FROM n WHERE key NOT IN (SELECT c_custkey FROM customer)
""")
def insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(None).cast("bigint").alias("source"), F.col("c_name").alias("note"))
    new = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1).alias("key"), F.col("o_orderkey").alias("source"), F.col("o_orderpriority").alias("note"))
    return ledger.insert_ignore(old, new, "key", ["source"])


@query("user_roles", """
    SELECT c_custkey, n_name AS role, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_key
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 ORDER BY c_custkey DESC
""")
def user_roles(spark, sf_dir):
    users = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    roles = table(spark, sf_dir, "nation", "n_nationkey", "n_name").filter("n_nationkey < 20").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("role")
    )
    keys = table(spark, sf_dir, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    full = ledger.users_with_roles(users, roles, "c_nationkey", keys, "c_custkey")
    return full.select("c_custkey", "role", "has_key").orderBy(F.desc("c_custkey"))


@query("scoped_runs", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey = 7")
def scoped_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return ledger.scope(o, "o_custkey", F.lit(7), F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")


@query("session_join", """
    SELECT event_id, user_id, c_name, n_name AS role FROM events JOIN customer ON c_custkey = user_id
      LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20
    WHERE ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-20 00:00:00'
""")
def session_join(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    users = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey").withColumnRenamed("c_custkey", "user_id")
    roles = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("role"))
    live = ledger.open_sessions(e, users, roles, "user_id", "c_nationkey", "ts", datetime(2024, 1, 20))
    return live.select("event_id", "user_id", "c_name", "role")


@query("first_admin", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def first_admin(spark, sf_dir):
    return ledger.first_admin(table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey")


@query("user_stats", """
    SELECT c_mktsegment, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (NOT c_acctbal > 0) AS inactive
    FROM customer GROUP BY 1
""")
def user_stats(spark, sf_dir):
    return ledger.user_stats(table(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal"), F.col("c_acctbal") > 0, "c_mktsegment")


@query("owner_rows", "SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1")
def owner_rows(spark, sf_dir):
    return ledger.owners_exist(table(spark, sf_dir, "orders", "o_custkey"), "o_custkey")


@query("storage_quota", """
    WITH u AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS used FROM documents GROUP BY 1),
      b AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS batch_bytes, CAST(max(n_chars) AS BIGINT) AS largest FROM documents WHERE lang <> 'en' GROUP BY 1)
    SELECT source, used, CAST(greatest(200000 - used, 0) AS BIGINT) AS available, CAST(floor(used / 200000 * 100 + 0.5) AS BIGINT) AS percent,
      batch_bytes, batch_bytes <= greatest(200000 - used, 0) AS fits, largest <= greatest(200000 - used, 0) AS largest_fits
    FROM u LEFT JOIN b USING (source)
""")
def storage_quota(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "source", "lang", "n_chars")
    usage = ledger.storage_usage(d, "source", "n_chars", F.lit(200_000).cast("bigint"))
    check = ledger.upload_check(d.filter("lang <> 'en'"), usage, "source", "n_chars").drop("largest")
    return usage.drop("quota").join(check, "source", "left")


@query("account_usage", """
    WITH s AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS spent FROM orders GROUP BY 1)
    SELECT o_custkey, CAST(spent AS DOUBLE) AS usage, round(5000000 - CAST(spent AS DOUBLE), 2) AS remaining,
      round(CAST(spent AS DOUBLE) / 5000000 * 100, 1) AS percent_used FROM s
""")
def account_usage(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice")
    spent = o.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("usage"))
    return ledger.account_usage(spent, F.lit(5_000_000.0)).select(
        "o_custkey", "usage", F.round("remaining", 2).alias("remaining"), "percent_used"
    )


def diagnostics(events: DataFrame) -> DataFrame:
    """The diagnostics feed behind the events: category, event, duration, tokens, valid."""
    kind = F.col("event_type")
    category = F.when(kind.isin("click", "error"), "api").when(kind.isin("view", "signup"), "generation").otherwise("validation")
    event = (
        F.when(kind == "click", "response").when(kind == "error", "error").when(kind == "view", "complete")
        .when(kind == "signup", F.when(F.col("value") > 50, "error").otherwise("start")).otherwise("complete")
    )
    return events.select(
        "*", category.alias("category"), event.alias("event"), (F.col("value") * 100).cast("bigint").alias("duration"),
        event_props().alias("tokens"), (F.col("value") > 20).alias("valid"),
    )


DIAGNOSTICS_SQL = """
d AS (
  SELECT ts, CASE WHEN event_type IN ('click', 'error') THEN 'api' WHEN event_type IN ('view', 'signup') THEN 'generation' ELSE 'validation' END AS category,
    CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false WHEN 'view' THEN true WHEN 'signup' THEN false ELSE value > 20 END AS good,
    event_type, CAST(trunc(value * 100) AS BIGINT) AS duration, CAST(props::JSON->>'k' AS BIGINT) AS tokens
  FROM events WHERE NOT (event_type = 'signup' AND value <= 50)
)
"""

REPORT_SQL = """
    count(*) AS total, count(*) FILTER (good) AS successful, count(*) FILTER (NOT good) AS failed,
    CAST(sum(duration) FILTER (category = 'api' OR event_type = 'view') AS BIGINT) AS total_duration,
    CAST(sum(CASE WHEN category = 'api' AND good THEN tokens END) AS BIGINT) AS total_tokens,
    coalesce(round(sum(duration) FILTER (category = 'api' OR event_type = 'view') / count(*), 6), 0e0) AS avg_duration,
    coalesce(round(sum(CASE WHEN category = 'api' AND good THEN tokens END) / nullif(count(*) FILTER (good), 0), 6), 0e0) AS avg_tokens
"""


def rounded_report(report: DataFrame) -> DataFrame:
    return report.withColumn("avg_duration", F.round("avg_duration", 6)).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query("metrics_report", f"WITH {DIAGNOSTICS_SQL} SELECT category, {REPORT_SQL} FROM d GROUP BY 1")
def metrics_report(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "value", "props")
    return rounded_report(ledger.metrics(diagnostics(e)))


@query("stale_runs", """
    SELECT user_id, max(ts) AS last_heartbeat FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 5 MINUTES
""")
def stale_runs(spark, sf_dir):
    beats = ledger.last_heartbeats(table(spark, sf_dir, "events", "user_id", "ts"), "user_id", "ts")
    return ledger.stale_runs(beats, datetime(2024, 1, 30, 12))


@query("run_sessions", """
    WITH g AS (
      SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 300 SECONDS THEN 0 ELSE 1 END AS opens FROM events
    ), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM s GROUP BY user_id, n
""")
def run_sessions(spark, sf_dir):
    rows = sessions(table(spark, sf_dir, "events", "user_id", "ts"), ["user_id"], "ts", ledger.STALE_SECONDS)
    return rows.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("last_seen").alias("end_us"), "events")


def _fixed_sql(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST(round({expr}, {digits}) AS DOUBLE))"


@query("format_scalars", f"""
    WITH o AS (SELECT *, CAST(o_orderkey * 1000 AS BIGINT) AS size, o_custkey * 100 AS ms FROM orders)
    SELECT o_orderkey,
      CASE WHEN size < 1024 THEN {_fixed_sql('CAST(size AS DOUBLE)', 2)} || ' B' WHEN size < 1048576 THEN {_fixed_sql('size / 1024e0', 2)} || ' KB'
        ELSE {_fixed_sql('size / 1048576e0', 2)} || ' MB' END AS size_text,
      CASE WHEN size = 0 THEN '0 B' ELSE regexp_replace(CASE WHEN size < 1024 THEN {_fixed_sql('CAST(size AS DOUBLE)', 2)} WHEN size < 1048576 THEN {_fixed_sql('size / 1024e0', 2)}
        ELSE {_fixed_sql('size / 1048576e0', 2)} END, '\\.?0+$', '') || CASE WHEN size < 1024 THEN ' B' WHEN size < 1048576 THEN ' KB' ELSE ' MB' END END AS trimmed,
      CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN {_fixed_sql('ms / 1000e0', 1)} || 's'
        ELSE (ms // 60000) || 'm ' || ((ms % 60000) // 1000) || 's' END AS took,
      '$' || printf('%.4f', o_totalprice) AS cost,
      CASE WHEN days < 1 AND hours < 1 THEN 'just now' WHEN days < 1 THEN hours || CASE WHEN hours > 1 THEN ' hours ago' ELSE ' hour ago' END
        WHEN days < 7 THEN days || CASE WHEN days > 1 THEN ' days ago' ELSE ' day ago' END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS age,
      'Progress: ' || (o_custkey + 1) || '/' || 2000000 || ' (' || CAST(floor((o_custkey + 1) / 2000000 * 100 + 0.5) AS BIGINT) || '%)' AS bar
    FROM (SELECT *, date_diff('hour', o_orderdate, TIMESTAMP '2001-08-02 00:00:00') AS hours, date_diff('day', o_orderdate, TIMESTAMP '2001-08-02 00:00:00') AS days FROM o)
""")
def format_scalars(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    size, ms = F.col("o_orderkey") * 1000, F.col("o_custkey") * 100
    return o.select(
        "o_orderkey", bytes_text(size).alias("size_text"), bytes_text_trimmed(size).alias("trimmed"), duration_text(ms).alias("took"),
        cost_text(F.col("o_totalprice")).alias("cost"),
        relative_time(F.col("o_orderdate"), F.lit(HISTORY_NOW)).alias("age"),
        progress_text(F.col("o_custkey") + 1, F.lit(2_000_000)).alias("bar"),
    )


def first_errors(errors: DataFrame, run: str, order: str, n: int = 3) -> DataFrame:
    """The first errors of every run."""
    return top_per_key(errors, [run], [F.col(order).asc()], n)


@query("run_errors", """
    SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS rank FROM events WHERE event_type = 'error'
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY row_number() OVER w <= 3
""")
def run_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type").filter("event_type = 'error'")
    return first_errors(e, "user_id", "event_id").select("user_id", "event_id", "rank")

