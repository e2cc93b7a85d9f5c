"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.schema_rules import SchemaRules
from quern.plans.analytics import DIAGNOSTICS_SQL, REPORT_SQL, diagnostics, rounded_report
from quern.plans.checking import FLAT_SCHEMA, FLAT_SQL, TAG_SQL, event_documents, tag_view
from quern.plans.generation import INFER_SQL, EventCompleter, answers_view, event_requests, no_wait
from quern.plans.registry import query
from quern.plans.tables import event_props, table
from quern.session import scratch_path
from quern.sources.readers import stream_table
from quern.streaming import jobs
from quern.streaming.expiry import expired
from quern.streaming.progress import ProgressLog

FEED_DELAY = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    return stream_table(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)


@query("stream_generate", INFER_SQL)
def stream_generate(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "generated"), scratch_path(spark, "generated-state")
    asked = event_requests(event_stream(spark, sf_dir))
    jobs.generate(
        asked, EventCompleter, ["event_id", "request_key"], out, checkpoint, group_delay=0.0, base_delay=0.0, sleep=no_wait
    ).awaitTermination()
    return answers_view(spark.read.parquet(f"{out}/items").unionByName(spark.read.parquet(f"{out}/errors")))


@query("stream_counts", """
    SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'errors' ELSE 'items' END AS kind, count(*) AS n FROM events GROUP BY 1
""")
def stream_counts(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "generated"), scratch_path(spark, "generated-state")
    asked = event_requests(event_stream(spark, sf_dir))
    jobs.generate(
        asked, EventCompleter, ["event_id", "request_key"], out, checkpoint, group_delay=0.0, base_delay=0.0, sleep=no_wait
    ).awaitTermination()
    return jobs.generation_counts(spark, out)


@query("stream_validate", TAG_SQL)
def stream_validate(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "tagged"), scratch_path(spark, "tagged-state")
    tagged = jobs.tag_stream(event_documents(event_stream(spark, sf_dir)), SchemaRules(FLAT_SCHEMA))
    jobs.append_table(jobs.counted(tagged, "checked").select("event_id", "_validation"), out, checkpoint).awaitTermination()
    return tag_view(spark.read.parquet(out))


@query("stream_index", """
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS "index" FROM events
""")
def stream_index(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "indexed"), scratch_path(spark, "indexed-state")
    rows = event_stream(spark, sf_dir).select("user_id", "event_id")
    jobs.number_results(rows, "user_id", "event_id", out, checkpoint).awaitTermination()
    return spark.read.parquet(f"{out}/records").select("user_id", "event_id", "index")


@query("stream_progress", """
    SELECT user_id, max(CAST(props::JSON->>'k' AS BIGINT)) AS current, arg_max(event_type, event_id) AS status, count(*) AS events
    FROM events GROUP BY 1
""")
def stream_progress(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "progress"), scratch_path(spark, "progress-state")
    feed = jobs.progress_feed(event_stream(spark, sf_dir), "user_id", event_props(), F.col("event_type"), F.col("event_id"))
    jobs.keep_latest(feed, out, checkpoint, ["user_id"]).awaitTermination()
    return jobs.read_latest(spark, out, ["user_id"])


@query("stream_sessions", """
    WITH g AS (
      SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 300 SECONDS THEN 0 ELSE 1 END AS opens FROM events
    ), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g),
    w AS (SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 300000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, n)
    SELECT * FROM w WHERE end_us <= (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM events)
""")
def stream_sessions(spark, sf_dir):
    """Sessions the watermark has closed; the open ones stay in the state."""
    out, checkpoint = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-state")
    timed = jobs.with_event_time(event_stream(spark, sf_dir).select("user_id", "ts"), "ts", FEED_DELAY)
    spans = jobs.heartbeat_sessions(timed, "user_id", "ts")
    rows = spans.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "events")
    jobs.append_table(rows, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def _metric_stream(spark: SparkSession, sf_dir: str, slide: str | None) -> DataFrame:
    out, checkpoint = scratch_path(spark, "metrics"), scratch_path(spark, "metrics-state")
    feed = diagnostics(event_stream(spark, sf_dir).select("ts", "event_type", "value", "props"))
    timed = jobs.with_event_time(feed, "ts", FEED_DELAY)
    jobs.keep_latest(jobs.live_metrics(timed, "ts", "1 hour", slide), out, checkpoint, ["window_start", "category"]).awaitTermination()
    rows = jobs.read_latest(spark, out, ["window_start", "category"])
    return rounded_report(rows).withColumn("window_start", F.unix_micros("window_start"))


@query("stream_metrics", f"""
    WITH {DIAGNOSTICS_SQL} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, category, {REPORT_SQL} FROM d GROUP BY 1, 2
""")
def stream_metrics(spark, sf_dir):
    return _metric_stream(spark, sf_dir, None)


@query("stream_metrics_sliding", f"""
    WITH {DIAGNOSTICS_SQL}, s AS (
      SELECT *, epoch_us(time_bucket(INTERVAL 30 MINUTES, ts)) - o * 1800000000 AS window_start FROM d, unnest([0, 1]) AS u(o)
    )
    SELECT window_start, category, {REPORT_SQL} FROM s GROUP BY 1, 2
""")
def stream_metrics_sliding(spark, sf_dir):
    return _metric_stream(spark, sf_dir, "30 minutes")


@query("stream_silent_runs", """
    WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events),
    g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= 300000 THEN 0 ELSE 1 END AS opens FROM e),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS n FROM g),
    w AS (SELECT user_id, min(ms) AS first_ms, max(ms) AS last_ms, max(ms) + 300000 AS expired_ms FROM s GROUP BY user_id, n)
    SELECT * FROM w WHERE expired_ms <= (SELECT max(ms) - 600000 FROM e)
""")
def stream_silent_runs(spark, sf_dir):
    """One event for every run that has been silent for five minutes."""
    out, checkpoint = scratch_path(spark, "silent"), scratch_path(spark, "silent-state")
    rows = expired(event_stream(spark, sf_dir), "user_id", "ts", 300_000, FEED_DELAY)
    jobs.append_table(rows, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("stream_expiring_sessions", """
    WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'signup')
    SELECT event_id, ms AS first_ms, ms AS last_ms, ms + 86400000 AS expired_ms FROM e WHERE ms + 86400000 <= (SELECT max(ms) - 600000 FROM e)
""")
def stream_expiring_sessions(spark, sf_dir):
    """Sessions opened by signups, a day after their last use."""
    out, checkpoint = scratch_path(spark, "expiring"), scratch_path(spark, "expiring-state")
    opened = event_stream(spark, sf_dir).where("event_type = 'signup'")
    jobs.append_table(expired(opened, "event_id", "ts", 86_400_000, FEED_DELAY), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("stream_progress_log", f"""
    WITH {FLAT_SQL}, c AS (SELECT count(*) AS total, count(n) AS bad FROM e LEFT JOIN per USING (event_id))
    SELECT 'input' AS metric, total AS count FROM c UNION ALL SELECT 'checked.valid', total - bad FROM c UNION ALL SELECT 'checked.invalid', bad FROM c
""")
def stream_progress_log(spark, sf_dir):
    """Counts that a listener has taken from a running check."""
    out, checkpoint = scratch_path(spark, "watched"), scratch_path(spark, "watched-state")
    log = ProgressLog(spark, scratch_path(spark, "progress-log"))
    spark.streams.addListener(log)
    try:
        tagged = jobs.tag_stream(event_documents(event_stream(spark, sf_dir)), SchemaRules(FLAT_SCHEMA))
        query = jobs.append_table(jobs.counted(tagged, "checked").select("event_id", "_validation"), out, checkpoint)
        query.awaitTermination()
        log.finished(query)
    finally:
        spark.streams.removeListener(log)
    mine = log.table().where(F.col("query") == query.id)
    return mine.groupBy("metric").agg(F.sum("count").alias("count"))
