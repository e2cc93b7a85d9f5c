"""Order work per key against brute force, with one key that holds a third of the rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import chat, ledger
from quern.operators.failures import error_rows, group_errors, top_groups
from quern.operators.running import running_totals, sessions, top_per_key
from quern.sources.writers import read_json_documents, write_json_documents


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.randrange(100)) for i in range(3000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, v long").repartition(5)


def test_running_totals(df, rows):
    out = running_totals(df, ["key"], ["id"], {"total": F.col("v"), "n": F.lit(1)}, F.floor(F.col("id") / 70))
    sums, want = defaultdict(lambda: [0, 0]), {}
    for key, i, v in sorted(rows, key=lambda r: r[1]):
        sums[key][0] += v
        sums[key][1] += 1
        want[i] = tuple(sums[key])
    assert {r.id: (r.total, r.n) for r in out.collect()} == want


def test_top_per_key(df, rows):
    got = top_per_key(df, ["key"], [F.col("v").desc(), F.col("id")], 4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    groups = defaultdict(list)
    for key, i, v in rows:
        groups[key].append((-v, i))
    want = {(k, i): n for k, g in groups.items() for n, (_, i) in enumerate(sorted(g)[:4], 1)}
    assert {(r.key, r.id): r.rank for r in got.collect()} == want


def test_sessions(spark):
    rng, start = random.Random(2), datetime(2024, 1, 1)
    events, t = [], start
    for i in range(900):
        t += timedelta(seconds=rng.choice([1, 5, 60, 60.000001, 61, 300]))
        events.append(("hot" if i % 3 else "cold", t))
    got = sessions(spark.createDataFrame(events, "key string, ts timestamp").repartition(4), ["key"], "ts", 60)
    want = []
    for key in ("hot", "cold"):
        last = None
        for k, at in events:
            if k == key:
                if last is None or at - last > timedelta(seconds=60):
                    want.append([key, at, at, 0])
                want[-1][2], want[-1][3], last = at, want[-1][3] + 1, at
    assert sorted((r.key, r.session_start, r.last_seen, r.events) for r in got.collect()) == sorted(map(tuple, want))


def test_error_groups(spark, rows):
    errors = [(i, [(f"/items/{v}/price" if key == "hot" else f"/{key}", "maximum", "should be <= 3")]) for key, i, v in rows]
    checked = spark.createDataFrame(errors, "id long, errors array<struct<path:string,keyword:string,message:string>>")
    groups = {r.field: r for r in group_errors(error_rows(checked, "id"), spread_by=("row_index",)).collect()}
    by_field = defaultdict(list)
    for key, i, v in rows:
        by_field["price" if key == "hot" else key].append(v if key == "hot" else i)
    assert set(groups) == set(by_field)
    for field, items in by_field.items():
        first = sorted(items)[:3]
        more = f", ... and {len(items) - 3} more" if len(items) > 3 else ""
        assert groups[field].n == len(items)
        assert groups[field].text == f"{field}: should be <= 3 (items: {', '.join(map(str, first))}{more})"
    top = top_groups(group_errors(error_rows(checked, "id"), spread_by=("row_index",))).collect()
    assert len(top) == 10 and top[0].field == "price"


@pytest.mark.parametrize("as_list", [True, False])
def test_documents_are_whole_json(spark, df, rows, tmp_path, as_list):
    import json

    path = str(tmp_path / "docs")
    results = df.select("key", "id", F.struct("id", "v").alias("item"))
    write_json_documents(results, path, "key", "id", "item", as_list)
    lines = defaultdict(list)
    for folder in sorted((tmp_path / "docs").glob("key=*")):
        for part in sorted(folder.glob("part-*")):
            lines[folder.name.removeprefix("key=")] += part.read_text().splitlines()
    for key, text in lines.items():
        doc = json.loads("\n".join(text))
        items = doc if as_list else doc[key]
        assert [d["id"] for d in items] == sorted(i for k, i, _ in rows if k == key)
    assert len(lines) == len({k for k, _, _ in rows})
    assert read_json_documents(spark, path).count() == len(rows) + 2 * len(lines)


def test_last_write_and_insert_ignore(spark, df, rows):
    got = {r.key: (r.id, r.v) for r in ledger.last_write(df, ["key"], ["id"], ["v"]).collect()}
    assert got == {k: (i, v) for k, i, v in sorted(rows, key=lambda r: r[1])}
    old = spark.createDataFrame([("hot", -1, -1)], "key string, id long, v long")
    merged = {r.key: r.id for r in ledger.insert_ignore(old, df, "key", ["id"]).collect()}
    want = {k: i for k, i, _ in sorted(rows, key=lambda r: -r[1])}
    assert merged == {**want, "hot": -1}


def test_chat_parts_and_bodies(spark):
    messages = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a"), (1, 3, "user", "u2"), (2, 0, "user", "q"), (3, 0, "assistant", "z")],
        "conv_id long, turn long, role string, text string",
    )
    files = spark.createDataFrame(
        [(1, 5, "b.TXT", "y" * 10001), (1, 2, "a", "x"), (1, 9, "pic.png", "binary"), (3, 1, "c.md", "c")], "conv_id long, no long, name string, text string"
    )
    parts = chat.attach(messages, files, "no")
    got = {r.conv_id: r for r in chat.request_bodies(parts).collect()}
    content = got[1].messages[3].content
    assert content == (
        "u2\n\n--- Attached Files ---\n\nFile: a\n```text\nx\n```\n\nFile: b.TXT\n```txt\n" + "y" * 10000 + "\n... [truncated]\n```\n"
    )
    assert [m.role for m in got[1].messages] == ["system", "user", "assistant", "user"] and got[3].messages[0].content == "z"
    small = {r.conv_id: r.too_large for r in chat.request_bodies(parts, max_bytes=500).collect()}
    assert small == {1: True, 2: False, 3: False}
