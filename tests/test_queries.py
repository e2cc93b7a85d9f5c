"""Registered queries against their SQL checks on the smallest tables.

A selection over all areas by default; TEST_ALL=1 runs every query (as does
``check.py``).
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, norm, same_type
from quern.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


SELECTED = (
    "task_expand context_build template_column translit task_key_file structure_prompt chat_requests replay_join infer_batch "
    "response_parse post_process generation_run validate_flat validate_nested validate_combinators custom_rules coerce "
    "schema_fields rule_dsl error_groups request_cost run_totals progress history_top insert_ignore session_join storage_quota "
    "metrics_report run_sessions format_scalars model_catalog facet_counts config_audit config_merge folder_size json_docs exports "
    "stream_generate stream_index stream_sessions stream_metrics validate_keywords chat_images ledger_rows text_files infer_rate resume_pieces "
    "stream_silent_runs stream_expiring_sessions stream_progress_log"
).split()
registry.load_all()
NAMES = sorted(registry.QUERIES) if os.environ.get("TEST_ALL") else SELECTED


@pytest.fixture(scope="module")
def db():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_a_check():
    registry.load_all()
    assert set(registry.QUERIES) == set(registry.CHECKS)
    assert set(registry.QUERIES) <= set(queries()) and set(registry.CHECKS) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    result = db.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert columns == sorted(names)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted((tuple(norm(row[i]) for i in order) for row in result.fetchall()), key=repr)
    kinds = dict(zip(names, [str(d[1]) for d in result.description]))
    assert all(same_type(kind, kinds[c]) for c, kind in df.dtypes)
