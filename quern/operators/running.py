"""Per-key order work that stays balanced when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column], block: Column,
    whole: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running sums per key in the given order, and sums over the whole key.

    ``block`` is a column that never falls while the order rises, for example the
    row index divided by a block size.  Rows are summed inside their (key, block)
    group; the totals of earlier blocks, one row per block, are added on top.  A
    key with many rows is spread over its blocks.
    """
    whole = whole or {}
    cut = df.select("*", block.alias("_block"), *[v.alias(f"_v_{n}") for n, v in {**totals, **whole}.items()])
    per_block = cut.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in {**totals, **whole}])
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals],
        *[F.sum(f"_b_{n}").over(every).alias(n) for n in whole],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in totals])
    # Rows without a key or block are rows of one key like any other.
    by = [*keys, "_block"]
    offsets = offsets.withColumnsRenamed({k: f"_k_{k}" for k in by})
    joined = summed.join(offsets, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
    kept = [c for c in df.columns if c not in totals and c not in whole]
    return joined.select(*kept, *[(F.col(f"_o_{n}") + F.col(f"_r_{n}")).alias(n) for n in totals], *whole)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key with their rank from 1.

    Spark keeps only ``n`` rows of a key in each task before the one shuffle
    (``spark.sql.optimizer.windowGroupLimitThreshold`` bounds such ``n``), so a
    hot key costs no more than any other.  Ties must be broken by ``order``.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Sessions per key: rows at most ``gap_seconds`` apart belong together.

    Rows inside one gap-sized slot of time always share a session, so they are
    combined first, map side; only slots are ordered per key.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    slots = (
        df.select(*keys, seconds.alias("_us"))
        .withColumn("_slot", F.floor(F.col("_us") / gap))
        .groupBy(*keys, "_slot")
        .agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count("*").alias("_n"))
    )
    by_time = Window.partitionBy(*keys).orderBy("_slot")
    opened = slots.withColumn(
        "_new", F.coalesce((F.col("_lo") - F.lag("_hi").over(by_time) > gap).cast("int"), F.lit(1))
    )
    numbered = opened.withColumn("_s", F.sum("_new").over(by_time))
    return numbered.groupBy(*keys, "_s").agg(
        F.timestamp_micros(F.min("_lo")).alias("session_start"),
        F.timestamp_micros(F.max("_hi")).alias("last_seen"),
        F.sum("_n").alias("events"),
    ).drop("_s")
