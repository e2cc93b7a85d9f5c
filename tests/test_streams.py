"""Streams over several micro-batches against their batch form."""

from collections import defaultdict

from pyspark.sql import functions as F

from quern.operators.schema_rules import SchemaRules
from quern.operators.validation import tag_invalid, with_errors
from quern.session import scratch_path
from quern.sources.readers import stream_table, with_json
from quern.streaming import jobs


def source(spark, tmp_path, rows, schema, parts=4):
    """The rows as files that arrive in order."""
    import os
    import time

    path = tmp_path / "in"
    path.mkdir()
    df = spark.createDataFrame(rows, schema)
    size = len(rows) // parts
    for n in range(parts):
        part = tmp_path / f"part{n}"
        chunk = spark.createDataFrame(rows[n * size:(n + 1) * size if n < parts - 1 else None], schema)
        chunk.coalesce(1).write.parquet(str(part))
        written = next(part.glob("*.parquet"))
        target = path / f"f{n}.parquet"
        target.write_bytes(written.read_bytes())
        os.utime(target, (time.time() + n, time.time() + n))
    return stream_table(spark, str(path) + "/", df.schema, files_per_trigger=1)


def test_index_continues_over_batches(spark, tmp_path):
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", i) for i in range(400)]
    out, state = scratch_path(spark, "indexed"), scratch_path(spark, "state")
    query = jobs.number_results(source(spark, tmp_path, rows, "key string, id long"), "key", "id", out, state)
    query.awaitTermination()
    seen, want = defaultdict(int), {}
    for key, i in rows:
        seen[key] += 1
        want[i] = seen[key]
    got = spark.read.parquet(f"{out}/records")
    assert got.select("batch").distinct().count() == 4
    assert {r.id: r["index"] for r in got.collect()} == want


def test_tagging_equals_batch(spark, tmp_path):
    rules = SchemaRules({"type": "object", "properties": {"n": {"type": "integer", "maximum": 5}}, "required": ["n"]})
    rows = [(i, f'{{"n":{i % 9}}}' if i % 4 else "{}") for i in range(80)]
    stream = with_json(source(spark, tmp_path, rows, "id long, text string"), F.col("text"))
    out = scratch_path(spark, "tagged")
    jobs.append_table(jobs.tag_stream(stream, rules).select("id", "_validation"), out, scratch_path(spark, "state")).awaitTermination()
    batch = tag_invalid(with_errors(with_json(spark.createDataFrame(rows, "id long, text string"), F.col("text")), rules)).select("id", "_validation")
    assert sorted(map(repr, spark.read.parquet(out).collect())) == sorted(map(repr, batch.collect()))


def test_latest_progress(spark, tmp_path):
    rows = [(f"r{i % 5}", i, "running" if i < 90 else "done") for i in range(100)]
    feed = jobs.progress_feed(source(spark, tmp_path, rows, "run string, n long, status string"), "run", F.col("n"), F.col("status"), F.col("n"))
    out = scratch_path(spark, "progress")
    jobs.keep_latest(feed, out, scratch_path(spark, "state"), ["run"]).awaitTermination()
    got = {r.run: (r.current, r.status, r.events) for r in jobs.read_latest(spark, out, ["run"]).collect()}
    assert got == {f"r{k}": (95 + k, "done", 20) for k in range(5)}
