"""Merkle manifest against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """Top, and for each leaf its siblings (left, right) from the leaf up."""
    proofs, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for proof, i in zip(proofs, at):
            first = i - i % 3
            proof.append(("".join(digests[first:i]), "".join(digests[i + 1 : first + 3])))
        digests = [h(*digests[i : i + 3]) for i in range(0, len(digests), 3)]
        at = [i // 3 for i in at]
    return digests[0], proofs


def plain_manifest(leaves):
    """``leaves``: (group, order, digest); to sorted (group, order, digest, subroot, root, proof)."""
    groups, out = defaultdict(list), []
    for group, order, digest in leaves:
        groups[group].append((order is not None, order or 0, digest))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([d for *_, d in sorted(groups[g])]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names])
    for g, rest in zip(names, above):
        top, proofs = trees[g]
        out += [(g, o if known else None, d, top, root, p + rest) for (known, o, d), p in zip(sorted(groups[g]), proofs)]
    return out


def key(row):
    return repr(row)


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [3, 4, 9, 10, 1], [27, 28, 2, 81, 82], [243, 244, 730, 5], [1] * 30 + [100]])
def test_manifest_of_any_size(spark, sizes):
    rows = [(f"g{k}" if k else None, None if i == 3 else i // 2, h(str(k), str(i)), 7) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string, tree int").repartition(5)
    found = merkle.manifest(df, "source", "doc_id")
    assert found.columns == [*df.columns, "subroot", "root", "proof"]
    folded = found.select("*", merkle.folded(F.col("leaf"), F.col("proof")).alias("up"), merkle.proof_digest(F.col("proof")).alias("sha")).collect()
    got = [(r.source, r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in folded]
    want = plain_manifest([r[:3] for r in rows])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(r.up == r.root and r.sha == h("".join(a + b for a, b in r.proof)) for r in folded)


def test_repeated_and_empty_rows(spark):
    rows = [("a", 1, h("x"))] * 5 + [("a", 1, h("y")), (None, None, h("z")), (None, None, h("z")), ("", 2, h("w"))]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string")
    got = [(r.source, r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in merkle.manifest(df, "source", "doc_id").collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert merkle.manifest(df.limit(0), "source", "doc_id").count() == 0


def test_a_hot_group_is_cut(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("source"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
        found = merkle.manifest(df, "source", "doc_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain_manifest([("hot" if i % 3 else str(i % 50), i, h(str(i))) for i in range(4000)])
    assert {(r.doc_id, r.root, tuple(map(tuple, r.proof))) for r in found} == {(w[1], w[4], tuple(w[5])) for w in want}


def test_op13_matches_plain_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    leaf = lambda r, text: h("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    want, cut = {}, {}
    for r in docs:
        odd = r.text is None or zlib.crc32(str(r.doc_id).encode()) % 2
        cut[r.doc_id] = leaf(r, r.text if odd else r.text.replace("\n", ""))
    for source, i, digest, top, root, proof in plain_manifest([(r.source, r.doc_id, leaf(r, r.text)) for r in docs]):
        node = cut[i]
        for a, b in proof:
            node = h(a, node, b)
        want[i] = (digest, top, root, h("".join(a + b for a, b in proof)), node, node == root)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = merkle.op13(spark, SF).select("doc_id", *names).collect()
    assert {r.doc_id: tuple(r[1:]) for r in found} == want and len(found) == len(want)
    assert 0 < sum(r.verified for r in found) < len(found)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(db.execute(f"SELECT doc_id, {', '.join(names)} FROM ({merkle.CHECK})").fetchall()) == sorted(map(tuple, found))
