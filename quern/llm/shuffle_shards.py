"""Sharding: a two-pass external shuffle.

Pass one scatters the rows over buckets that fit a task's memory: the shard is
the one of highest seeded hash for the identifier (so one more shard takes rows
only into itself), the bucket within a shard a seeded hash of the row's place in
the input, so that repeated rows and null identifiers spread too.  Pass two
loads one bucket at a time, permutes it by Fisher-Yates and writes it.  The
order of a shard is that of its buckets, then of the rows within each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.registry import query
from quern.llm.shared import read_table
from quern.session import scratch_path

BUCKET_BYTES = 32 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose hash with ``key`` is highest."""
    bids = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("bid"), F.lit(s).alias("shard")) for s in range(shards)]
    return (F.greatest(*bids) if shards > 1 else bids[0])["shard"]


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


@dataclass(frozen=True)
class Shards:
    """A written set of shards: ``path/shard=<n>/`` holds its rows in files of whole buckets."""

    path: str
    shards: int
    spark: SparkSession
    schema: T.StructType

    def rows(self) -> DataFrame:
        """row (the input row), shard, _bucket, _rank."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def manifest(self) -> DataFrame:
        """shard, _bucket, rows, first_slot."""
        counts = self.rows().groupBy("shard", "_bucket").agg(F.count("*").alias("rows"))
        before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("first_slot", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def _fisher_yates(seed: int):
    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket = table.column("_bucket").to_numpy()
        order, rank = [], []
        # A task holds one bucket, or a few where their number was raised or lowered.
        for b in np.unique(bucket):
            at = np.flatnonzero(bucket == b)
            rng = np.random.default_rng([seed, int(b)])
            last = np.arange(len(at) - 1, 0, -1)
            for i, j in zip(last.tolist(), rng.integers(0, last + 1).tolist()):
                at[i], at[j] = at[j], at[i]
            order.append(at)
            rank.append(np.arange(len(at), dtype=np.int64))
        shuffled = table.take(pa.array(np.concatenate(order)))
        shuffled = shuffled.append_column("_rank", pa.array(np.concatenate(rank)))
        yield from shuffled.to_batches(max_chunksize=2000)

    return permute


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", text_col: str = "text", seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> Shards:
    """Write the rows of ``df``, shuffled, to ``shards`` folders below ``path``.

    ``df`` is a table that reads the same on a second try (the place of a row
    enters its bucket).  Rows with a null key share a shard, not a bucket; null
    and empty texts, repeated rows and columns of any name are kept as they are.
    An empty table writes no rows.  A bucket holds about ``bucket_bytes`` of text
    however many rows a shard gets.
    """
    spark = df.sparkSession
    placed = df.select(F.struct("*").alias("row"), shard_of(F.col(key), shards, seed).alias("shard"), row_bytes(F.col(text_col)).alias("bytes"))
    sizes = {r.shard: r.bytes for r in placed.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row for each shard
    buckets = [sizes.get(s, 0) // bucket_bytes + 1 for s in range(shards)]
    first = [sum(buckets[:s]) for s in range(shards)]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("shard") + 1)
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    scattered = placed.withColumn("_bucket", (pick(first) + F.pmod(place, pick(buckets))).cast("int")).drop("bytes")
    scattered = scattered.repartitionById(sum(buckets), F.col("_bucket"))
    schema = T.StructType([*scattered.schema.fields, T.StructField("_rank", T.LongType())])
    shuffled = scattered.mapInArrow(_fisher_yates(seed), schema).sortWithinPartitions("shard", "_bucket", "_rank")
    shuffled.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return Shards(path, shards, spark, T.StructType([f for f in schema if f.name != "shard"] + [schema["shard"]]))


@query("op2_two_pass_shuffle")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in eight shards, read back from the written files."""
    seed, shards = 11, 8
    written = write_shards(read_table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), shards, seed=seed)
    text = F.col("row.text")
    rows = written.rows().select(
        F.col("row.doc_id").alias("doc_id"), row_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "_bucket", "_rank",
    )
    placed = rows.join(written.manifest().drop("rows"), ["shard", "_bucket"])
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("first_slot") + F.col("_rank")).alias("slot"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
