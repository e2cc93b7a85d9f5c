"""Embedding near-dedup by sorted projection passes.

A pass hashes each vector to a string of random hyperplane signs, orders the
vectors of a label lexicographically by it and compares each with its
neighbours: those up to ``window`` places on, and all with the very same string,
however many.  Verified pairs are united over the passes.

Bits and passes follow the vectors of a label: however dense they lie, two at the
limit share a string in one of the passes with probability ``RECALL``.

Equal vectors are one class with a count.  Places are dealt out as pairs of
blocks of a fixed number of rows, so a label or string with a third of all rows
meets no task whole.  A pair counts in the first pass that compares it, which
both rows know from their places in every pass; so link counts need no shuffle
of pairs, and a task returns counts and the links of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import forest, group_bounds, link_classes, read_table, stored, whole_groups

COSINE = 0.93
#: Least passes; larger labels get more (``passes_for``).
PASSES = 10
RECALL = 0.99
SHARED = 64
WINDOW = 48
BLOCK = 256
SEED = 5
#: A pair of blocks; at the border of two passes a block holds rows of both, which are never compared.
GROUP = ["pass", "a", "b"]


def sign_bits(rows: int) -> int:
    """Bits of a pass over a label of ``rows`` vectors: as many as leave at most 64 of them a string at random."""
    return min(max(math.ceil(math.log2(max(rows, 1) / SHARED)), 0), 60)


def passes_for(rows: int, least: int = PASSES, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes over a label of ``rows`` vectors: two at ``cosine`` get the same string in one of them with probability ``recall``.

    One is enough without bits, when all rows have the same string.
    """
    bits = sign_bits(rows)
    if not bits:
        return 1
    same = (1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi) ** bits
    return least if same >= 1 else max(least, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def usable(vector: Column) -> Column:
    """False for null, empty and zero vectors and those with null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(~odd & some, F.lit(False))


def _signs(least: int, cosine: float, seed: int):
    @F.pandas_udf("array<long>")
    def sign(vectors: pd.Series, rows: pd.Series) -> pd.Series:
        out = [None] * len(vectors)
        alike: dict[tuple[int, int], list[int]] = {}
        for i, (v, n) in enumerate(zip(vectors, rows)):
            alike.setdefault((len(v), n), []).append(i)
        for (size, n), at in alike.items():
            passes, bits = passes_for(n, least, cosine), sign_bits(n)
            planes = np.random.default_rng([seed, size]).normal(size=(size, passes * bits))
            x = np.array([vectors.iloc[i] for i in at], dtype=np.float64)
            weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
            keys = ((x @ planes >= 0).reshape(len(at), passes, bits) * weights).sum(axis=2)
            for i, k in zip(at, keys):
                out[i] = k
        return pd.Series(out, dtype=object)

    return sign


def _number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, n = TaskContext.get().partitionId(), 0
    for frame in frames:
        yield frame.assign(part=part, local=np.arange(n, n + len(frame), dtype=np.int64))
        n += len(frame)


def places(keys: DataFrame) -> DataFrame:
    """``keys`` (pass, label, size, key, cid) with rank, the place in their order over all passes, and the range of equal keys."""
    order = ["pass", "label", "size", "key", "cid"]
    sorted_ = keys.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(sorted_.mapInPandas(_number, "pass int, label int, size int, key long, cid long, part int, local long"), "places")
    parts = numbered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = numbered.join(parts, "part").withColumn("rank", F.col("base") + F.col("local")).drop("part", "local", "base")
    runs = ranked.groupBy("pass", "label", "size", "key").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return ranked.join(runs, ["pass", "label", "size", "key"])


def _compare(cosine: float, window: int, block: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, GROUP, 4000):
            at = group_bounds(frame, GROUP)
            ids, n = frame["cid"].to_numpy(), frame["n"].to_numpy()
            links = np.zeros(len(frame), np.int64)
            one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lo, hi in zip(at.tolist(), at[1:].tolist()):
                for i, j in _group_pairs(frame.iloc[lo:hi], cosine, window, block):
                    i, j = i + lo, j + lo
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    one.append(i)
                    two.append(j)
            # The same class stands in several groups; its rows are one node.
            known, node = np.unique(ids, return_inverse=True)
            i, j = node[np.concatenate(one)], node[np.concatenate(two)]
            root = forest(len(known), i, j)
            tied = np.flatnonzero(root != np.arange(len(known)))
            total = np.bincount(node, weights=links, minlength=len(known)).astype(np.int64)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"cid": known[some], "links": total[some], "root": pd.array([None] * len(some), dtype="Int64")})
            yield pd.DataFrame({"cid": known[tied], "links": np.zeros(len(tied), np.int64), "root": pd.array(known[root[tied]], dtype="Int64")})

    return run


def _group_pairs(g: pd.DataFrame, cosine: float, window: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one pair of blocks that this pass is the first to compare and that are close."""
    rank, label, a, b = g["rank"].to_numpy(), g["label"].to_numpy(), g["a"].iloc[0], g["b"].iloc[0]
    first = np.flatnonzero(rank // block == a)
    second = np.flatnonzero(rank // block == b)
    if not len(first) or not len(second):
        return
    turn = int(g["pass"].iloc[0])
    size = g["vector"].map(len).to_numpy()
    for n, of in set(zip(size[first].tolist(), label[first].tolist())):  # rows of one label have as many passes
        i, j = (k[(size[k] == n) & (label[k] == of)] for k in (first, second))
        if not len(j):
            continue
        spots, runs = (tuple(np.array(g[c].iloc[k].tolist()) for k in (i, j)) for c in ("spots", "runs"))
        x, y = (np.array(g["vector"].iloc[k].tolist(), dtype=np.float64) for k in (i, j))
        with np.errstate(over="ignore"):
            x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
        near = (x @ y.T) / np.outer(np.sqrt((x**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1))) >= cosine
        p, q = np.nonzero(near)
        seen = (np.abs(spots[0][p] - spots[1][q]) <= window) | (runs[0][p] == runs[1][q])
        p, q = i[p], j[q]
        now = (rank[p] < rank[q]) & seen[:, turn] & ~seen[:, :turn].any(axis=1)
        yield p[now], q[now]


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Rows are compared when their labels are equal and not null and their vectors
    equally long.  Unusable vectors (``usable``) link with nothing; such a row is
    its own component.  Null ids name a component only in the sense that it then
    has a null id and no kept row.  Repeated rows are rows of one class and link
    with each other.  Pairs below ``cosine`` never link; of those above, a pass
    finds the ones that fall into a window or share a string.  An empty table
    gives no rows; further columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("int").alias("label"))
    fit = usable(F.col("vector")) & F.col("label").isNotNull()
    good = rows.where(fit)
    classes = good.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    sizes = classes.groupBy("label", F.size("vector").alias("size")).agg(F.count("*").alias("rows"))
    sized = classes.withColumn("size", F.size("vector")).join(sizes, ["label", "size"])
    signs = _signs(passes, cosine, seed)
    keys = sized.select("cid", "label", "size", F.posexplode(signs(F.col("vector"), F.col("rows"))).alias("pass", "key"))
    placed = stored(places(keys).select("cid", "pass", "rank", "lo", "hi"), "ranks")
    # One entry a pass and class.
    mine = placed.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("pass", "rank", "lo", "hi"))).alias("at"))
    known = classes.select("cid", "label", "vector", "n").join(mine, "cid")
    dealt = known.select("cid", "label", "vector", "n", F.col("at.rank").alias("spots"), F.col("at.lo").alias("runs"), F.explode("at").alias("p"))
    own = F.floor(F.col("p.rank") / block)
    lowest = F.floor(F.least(F.greatest(F.col("p.rank") - window, F.lit(0)), F.col("p.lo")) / block)
    highest = F.floor(F.greatest(F.col("p.rank") + window, F.col("p.hi")) / block)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(lowest, highest)))
    dealt = dealt.select(
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "cid", "label", "vector", "n", "spots", "runs",
        F.col("p.pass").alias("pass"), F.col("p.rank").alias("rank"),
    )
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = stored(dealt.mapInPandas(_compare(cosine, window, block), "cid long, links long, root long"), "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = link_classes(found.where("root IS NOT NULL").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    rooted = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").join(counts, "cid", "left")
    known = known.select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    done = good.join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


@query("op9_projection_passes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_vectors(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
