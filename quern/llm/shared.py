"""What the operators of this folder share: written tables, connected classes, tables of the driver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import scratch_path, shared_folder

#: Bytes that count as white space in normalised texts.
BLANKS = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables written since each open ``scratch`` block began, the innermost last.
_WRITTEN: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder that all executors share, and read again.

    Later steps read the files, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for the table goes when it stands
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that ``stored`` wrote in this block, but for those taken out of the yielded list of paths."""
    _WRITTEN.append([])
    try:
        yield _WRITTEN[-1]
    finally:
        for path in _WRITTEN.pop():
            delete_table(spark, path)


def delete_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` texts to Python at once: long texts, and what is made of them, stay small beside a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 within ``tree`` (not null) in ``order``.

    A tree with most rows is spread over many partitions of the range sort; what is
    summed per tree is one count a partition.
    """
    parts = rows.repartitionByRange(*[F.col(c) for c in [tree, *order]]).sortWithinPartitions(tree, *order)
    placed = stored(parts.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(tree, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.withColumn("_part", part).join(starts, [tree, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def link_classes(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components: ``edges`` (u, v) to (node, root), root the smallest node.

    Alternating large-star and small-star rounds: every node hands its larger,
    then its smaller neighbours to the smallest one it knows, until nothing
    changes.  Each round is two partial minima and two joins on the node; the
    centre of a big star is only skewed on one side of those joins, which
    adaptive execution splits.  Rounds grow with the logarithm of the longest
    chain.  Nothing but two numbers a round reaches the driver.  Rows with a
    null end and self links are ignored; nodes without links are not returned.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    pairs = cut_lineage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours move to the smallest node around u.
        large = pairs.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours, and u itself, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = cut_lineage(small.where("u <> v").distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    rooted = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Frames sorted by ``keys``, cut anew so that no group is divided and each has about ``rows`` rows."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        n += len(frame)
        if n < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        changed = (whole[keys].to_numpy()[1:] != whole[keys].to_numpy()[:-1]).any(axis=1)
        cuts = np.flatnonzero(changed)
        if len(cuts):
            yield whole.iloc[: cuts[-1] + 1].reset_index(drop=True)
            whole = whole.iloc[cuts[-1] + 1 :]
        held, n = [whole], len(whole)
    if n:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted frame begin, and its end."""
    values = frame[keys].to_numpy()
    return np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(frame)]])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links i-j, the smallest node of each one's component."""
    root = np.arange(n)
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        open_ = low != high
        if not open_.any():
            break
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
