"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Every row is a leaf: the digest of its fields.  The leaves of one group, in order,
form a tree in which ``ARITY`` neighbours become their digest until one node
remains, the group's subroot; the subroots, ordered by group, form a tree in the
same way, whose last node is the root.

A node holds the siblings on its left and right.  Proofs grow by self-joins of the
table of nodes: each node knows an ancestor and the segment of siblings up to it;
joined with that ancestor's row it learns an ancestor twice as far and the
concatenated segment.  After log2(height) joins every leaf holds its whole proof.
From round to round only nodes on every second, fourth, eighth level are still
asked, so the table shrinks to little more than the leaves.

Digests are lowercase hex SHA-256 of concatenated inputs.  No group is gathered:
leaves are numbered by a range sort and the counts of its partitions, and trees are
built in runs of ``ARITY ** LEVELS`` neighbours.

Rows without a group form a group of their own, the first; rows without an order
key come first; ties and repeated rows follow the leaf digest, so equal rows change
places without a trace.  Null fields are ``-``.  A table without rows has neither
root nor rows.  Other input columns do not matter; those of a field list must exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import numbered, read_table, stored

ARITY = 3
#: Levels that one pass over runs of nodes builds; a run has ARITY ** LEVELS nodes.
LEVELS = 5


def field_bytes(value: Column) -> Column:
    """One field of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and its value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_bytes, fields)), 256)


def _parents(nodes: Column) -> Column:
    """Digests of every ``ARITY`` neighbours of an array of digests, the last run with fewer."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / ARITY).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """All nodes above and at ``leaves`` (tree, idx, digest): tree, level, idx, digest, left, right, height.

    ``left`` and ``right`` are the concatenated digests of the siblings before and
    after the node, empty at the top, whose level is ``height``.
    """
    run = ARITY**LEVELS
    sizes = leaves.groupBy("tree").agg((F.max("idx") + 1).alias("n"))
    out, level, current = None, 0, leaves.select("tree", "idx", "digest")
    while True:
        runs = current.groupBy("tree", F.floor(F.col("idx") / run).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("x"))
        runs = runs.withColumn("l0", F.transform("x", lambda x: x["digest"])).drop("x")
        for k in range(LEVELS):
            runs = runs.withColumn(f"l{k + 1}", _parents(F.col(f"l{k}")))
        built = stored(runs.join(sizes, "tree"), "tree-levels")
        flat = []
        for k in range(LEVELS):
            here = F.col(f"l{k}")
            at = F.col("pos") + F.col("run") * F.lit(ARITY ** (LEVELS - k))
            first = F.col("pos") - F.col("pos") % ARITY
            joined = lambda start, count: F.array_join(F.slice("nodes", start, count), "")
            node = built.select("tree", "run", "n", here.alias("nodes"), F.posexplode(here).alias("pos", "digest"))
            flat.append(node.select(
                "tree", F.lit(level + k).alias("level"), at.alias("idx"), "digest",
                joined(first + 1, F.col("pos") - first).alias("left"), joined(F.col("pos") + 2, first + ARITY - 1 - F.col("pos")).alias("right"), "n",
            ))
        for nodes in flat:
            out = nodes if out is None else out.union(nodes)
        level += LEVELS
        current = built.select("tree", F.col("run").alias("idx"), F.element_at(f"l{LEVELS}", 1).alias("digest"), "n")
        # A tree ends at the level where its leaves have become one node; longer ones go on.
        current = current.where(F.col("n") > ARITY ** (level - 1))
        if current.isEmpty():
            break
        current = current.drop("n")
    height = F.aggregate(F.sequence(F.lit(1), F.lit(level)), F.struct(F.col("n").alias("n"), F.lit(0).alias("h")), _climb, lambda s: s["h"])
    return out.withColumn("height", height).where("level <= height").drop("n")


def _climb(state: Column, _: Column) -> Column:
    more = (state["n"] > 1).cast("int")
    return F.struct(F.ceil(state["n"] / ARITY).alias("n"), (state["h"] + more).alias("h"))


def proofs(nodes: DataFrame) -> DataFrame:
    """For each leaf of ``nodes``: tree, idx, digest, top (the digest of its tree) and proof.

    ``proof`` is an array of (left, right), one for each level from the leaf up.
    """
    table = nodes.select(
        "tree", "level", "idx", "digest", "height", F.least(F.col("level") + 1, F.col("height")).alias("up_level"),
        F.when(F.col("level") < F.col("height"), F.floor(F.col("idx") / ARITY)).otherwise(F.col("idx")).alias("up_idx"),
        F.when(F.col("level") < F.col("height"), F.array(F.struct("left", "right"))).otherwise(F.array().cast("array<struct<left:string,right:string>>")).alias("proof"),
    )
    tops = nodes.where("level = height").select("tree", F.col("digest").alias("top"))
    most = nodes.agg(F.max("height")).first()[0] or 0
    step = 1
    while step < most:
        table = stored(table, "proofs")
        asked = table.where(F.col("level") % (2 * step) == 0)
        # The ancestors: nodes `step` levels up, or the top of a tree that ends before.
        above = table.where((F.col("level") % step == 0) | (F.col("level") == F.col("height"))).where("level > 0").select(
            F.col("tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"),
            F.col("up_level").alias("next_level"), F.col("up_idx").alias("next_idx"), F.col("proof").alias("more"),
        )
        # The top of a tree stays in the table whatever its level: pointers end there.
        asked = asked.union(table.where((F.col("level") % (2 * step) != 0) & (F.col("level") == F.col("height"))))
        joined = asked.join(above, ["tree", "up_level", "up_idx"], "left")
        table = joined.select(
            "tree", "level", "idx", "digest", "height", F.coalesce("next_level", "up_level").alias("up_level"),
            F.coalesce("next_idx", "up_idx").alias("up_idx"), F.concat("proof", F.coalesce("more", F.array())).alias("proof"),
        )
        step *= 2
    return table.where("level = 0").join(tops, "tree").select("tree", "idx", "digest", "top", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The top that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(leaves: DataFrame, group: str, order: str, leaf: str = "leaf") -> DataFrame:
    """Rows of ``leaves`` with subroot, root and ``proof``, siblings (left, right) from the leaf to the root.

    ``group`` parts the rows, ``order`` orders them within a group, ``leaf`` is
    their digest; all other columns come along.
    """
    tree = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit(""))
    rows = leaves.select(F.struct("*").alias("row"), tree.alias("tree"), F.col(order).alias("key"), F.col(leaf).alias("digest"))
    placed = stored(numbered(rows, "tree", ["key", "digest"]), "leaves")
    inner = stored(proofs(stored(tree_nodes(placed), "nodes")), "proofs")
    # The tree above: its leaves are the subroots, in the order of their groups.
    subroots = inner.where("idx = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("top").alias("digest"))
    tops = numbered(subroots, "tree", ["key"])
    outer = proofs(stored(tree_nodes(tops), "top-nodes")).join(tops.select("idx", "key"), "idx")
    outer = outer.select(F.col("key").alias("tree"), F.col("top").alias("root"), F.col("proof").alias("rest"))
    whole = inner.join(outer, "tree").select("tree", "idx", F.col("top").alias("subroot"), "root", F.concat("proof", "rest").alias("proof"))
    kept = [F.col("row")[c].alias(c) for c in leaves.columns if c not in ("subroot", "root", "proof")]
    return placed.select("row", "tree", "idx").join(whole, ["tree", "idx"]).select(*kept, "subroot", "root", "proof")


CHECK = """
WITH RECURSIVE poly AS (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
    FROM range(256) r(i)),
docs AS (
    SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS rid,
        CAST(doc_id AS VARCHAR) AS name FROM documents),
coded AS (
    SELECT docs.*, CASE WHEN doc_id IS NULL THEN 1 ELSE
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda s, b: xor(s >> 8, poly.crc[(xor(s, b) & 255) + 1])), 4294967295) END AS code
    FROM docs, poly),
cut AS (
    SELECT *, CASE WHEN code % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut_text,
        coalesce(strlen(name) || ':' || name, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM coded),
leaves AS (
    SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(cut_text) || ':' || cut_text, '-')) AS cut_leaf FROM cut),
tree AS (
    SELECT coalesce('g' || source, '') AS tree, 0 AS level, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (min(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY tree, level, idx // 3),
subroots AS (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS groups FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS level, place AS idx, subroot AS digest, groups AS n FROM subroots
    UNION ALL
    SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (min(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, idx // 3),
walk AS (
    SELECT rid, doc_id, leaf, coalesce('g' || source, '') AS tree, 0 AS level,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, cut_leaf AS node, '' AS proof FROM leaves
    UNION ALL
    SELECT w.rid, any_value(w.doc_id), any_value(w.leaf), any_value(w.tree), w.level + 1, w.idx // 3,
        sha256(string_agg(CASE WHEN t.idx = w.idx THEN w.node ELSE t.digest END, '' ORDER BY t.idx)),
        any_value(w.proof) || coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx <> w.idx), '')
    FROM walk w JOIN tree t ON t.tree = w.tree AND t.level = w.level AND t.idx // 3 = w.idx // 3 AND t.n > 1 GROUP BY w.rid, w.level, w.idx),
up AS (
    SELECT w.rid, w.doc_id, w.leaf, s.subroot, 0 AS level, s.place AS idx, w.node, w.proof
    FROM walk w JOIN subroots s ON s.name = w.tree JOIN tree t ON t.tree = w.tree AND t.level = w.level AND t.n = 1
    UNION ALL
    SELECT w.rid, any_value(w.doc_id), any_value(w.leaf), any_value(w.subroot), w.level + 1, w.idx // 3,
        sha256(string_agg(CASE WHEN t.idx = w.idx THEN w.node ELSE t.digest END, '' ORDER BY t.idx)),
        any_value(w.proof) || coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx <> w.idx), '')
    FROM up w JOIN top t ON t.level = w.level AND t.idx // 3 = w.idx // 3 AND t.n > 1 GROUP BY w.rid, w.level, w.idx)
SELECT u.doc_id, u.leaf, u.subroot, t.digest AS root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node = t.digest AS verified
FROM up u JOIN top t ON t.level = u.level AND t.n = 1
"""


@query("op13_pointer_jumping", CHECK)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its tampered text gives."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(
        "doc_id", "source", leaf_digest(*head, F.col("text")).alias("leaf"),
        F.when(tampered, leaf_digest(*head, F.replace("text", F.lit("\n"), F.lit("")))).alias("found"),
    )
    rows = manifest(leaves, "source", "doc_id")
    # Sent as an array of digests; what is returned is derived from it row by row.
    rows = rows.withColumn("folded_root", folded(F.coalesce("found", "leaf"), F.col("proof")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
