"""Hard negatives against all inner products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hard_negatives as hn

SF = "/root/testdata/sf0.001"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """``rows``: (id, label, vector of integers) that take part; ``anchors``: ids."""
    width = max((len(v) for *_, v in rows), default=0)
    vectors = np.array([[*v, *[0] * (width - len(v))] for *_, v in rows], dtype=object)
    out = []
    for a, (aid, alabel, _) in enumerate(rows):
        if aid not in anchors:
            continue
        score = vectors @ vectors[a]
        ranked = sorted((k for k in range(len(rows)) if k != a), key=lambda k: (-score[k], rows[k][0]))
        for p in [k for k in ranked if rows[k][1] == alabel][:positives]:
            window = [k for k in ranked if rows[k][1] != alabel and low * score[p] <= 100 * score[k] <= high * score[p]][:negatives]
            out += [(aid, rows[p][0], r + 1, rows[k][0], int(score[p]), int(score[k])) for r, k in enumerate(window)]
    return sorted(out)


def run(spark, rows, anchor=lambda c: c % 5 == 0):
    df = spark.createDataFrame(rows, "vec_id long, label int, vec array<long>, uid string").repartition(3)
    return sorted(map(tuple, hn.hard_negatives(df, anchor(F.col("vec_id"))).collect()))


@pytest.mark.parametrize("kind", ["unit", "wide", "ties", "one label", "many labels"])
def test_against_all_products(spark, kind, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 64)
    monkeypatch.setattr(hn, "PACK", 8)
    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=(n, 20))
    x = {"unit": 256 * x / np.linalg.norm(x, axis=1)[:, None], "wide": 50 * x * rng.pareto(1, (n, 1)), "ties": rng.integers(-1, 2, (n, 20))}.get(kind, 30 * x)
    label = {"one label": np.zeros(n, int), "many labels": np.arange(n) // 3}.get(kind, np.minimum(rng.integers(0, 9, n), 5))
    rows = [(i, int(label[i]), [int(v) for v in np.floor(x[i])]) for i in range(n)]
    want = brute(rows, set(range(0, n, 5)))
    assert run(spark, [(*r, "u") for r in rows]) == want
    assert bool(want) == (kind != "one label")


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [int(v) for v in rng.integers(-9, 10, 1 + i % 4)]) for i in range(40)]
    rows += [(5, 1, rows[5][2]), (5, 1, rows[5][2]), (7, 0, [0, 0]), (50, 0, []), (55, 1, [3] * 6), (-10, 0, [2, 2, 2])]
    odd = [(None, 1, [9, 9]), (60, None, [9, 9]), (65, 1, None)]
    assert run(spark, [(*r, "u") for r in rows + odd]) == brute(rows, {i for i, *_ in rows if i % 5 == 0})
    assert run(spark, [(*r, "u") for r in odd]) == []


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [int(v) for v in rng.integers(-(1 << 30), 1 << 30, 4)]) for i in range(60)]
    assert run(spark, [(*r, "u") for r in rows]) == brute(rows, set(range(0, 60, 5)))


def test_scores_up_to_the_largest_long(spark):
    rng = np.random.default_rng(8)
    # Norms near sqrt(2 ** 63): scores on both sides of 2 ** 62, close ones apart by little.
    near = [(i, i % 3, [1_500_000_000 + int(v) for v in rng.integers(0, 9, 2)] + [int(v) for v in rng.integers(0, 3 + 10**9 * (i % 3 > 0), 2)]) for i in range(60)]
    far = [(61, 9, [1 << 62, -(1 << 61)]), (62, 8, [-(1 << 62), 1 << 60])]
    want = brute(near + far, set(range(0, 60, 5)))
    assert run(spark, [(*r, "u") for r in near + far]) == want
    assert max(w[4] for w in want) > 1 << 62


def test_vectors_without_components(spark):
    rows = [(i, i % 2, []) for i in range(12)]
    want = brute(rows, {0, 5, 10})
    assert run(spark, [(*r, "u") for r in rows]) == want and len(want) == 45


def test_blocks_sort_rows_that_come_in_any_order(spark):
    rows = [(u, u, u // 4, [u, 1]) for u in reversed(range(40))]
    df = spark.createDataFrame(rows, "uid long, id long, label long, vec array<long>").repartition(7)
    got = hn.blocks_of(df, [0, 1]).first()
    assert np.frombuffer(got.uids, "<i8").tolist() == list(range(40))
    assert np.frombuffer(got.row_labels, "<i8").tolist() == [u // 4 for u in range(40)]


def test_usable_and_quantised(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("inf")]), (4, [None]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    assert [r.id for r in df.where(hn.usable(F.col("v"))).collect()] == [1, 6]
    assert df.where("id = 1").select(hn.quantised(F.col("v")).alias("q")).first().q == [128, -1]


def test_index_prunes_and_loses_nothing():
    rng = np.random.default_rng(7)
    rows, anchors = rng.integers(-99, 100, (500, 24)) * rng.integers(0, 3, (500, 1)), rng.integers(-99, 100, (9, 24))
    scores = anchors @ rows.T
    edges = [0, 8, 16, 24]
    for least in (np.full(9, 60_000), np.full(9, 20_000), np.full(9, -(1 << 62)), np.arange(9) * 9_000 - 20_000):
        i, j, s = hn.Index(rows, edges).scores(anchors, least)
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(scores >= least[:, None]))) and (scores[i, j] == s).all()


def test_op12_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = hn.op12(spark, SF)
    want = sorted(db.execute(f"SELECT {', '.join(found.columns)} FROM ({hn.CHECK})").fetchall())
    assert sorted(map(tuple, found.collect())) == want and want
