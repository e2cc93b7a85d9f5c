"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the longest sequence are cut into pieces of that length and a
rest, so nothing is truncated.  Pieces are dealt evenly to packing groups of a
bounded number of pieces and packed group by group, longest first: a piece goes
to the open bin that it fills best; if none can take it, a bin of the length
with the least cost a unit opens, counting how full the group's remaining pieces
can make it.  Finally each bin is downsized to the shortest permitted length
that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import read_table, stored


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths and what a sequence of ``n`` units costs: fixed + n + square * n^2."""

    sizes: tuple[int, ...] = (512, 1024, 2048)
    fixed: float = 32.0
    square: float = 4e-5

    def cost(self, n: int) -> float:
        return self.fixed + n + self.square * n * n


def pack(pieces: list[int], lengths: Lengths = Lengths()) -> tuple[list[int], list[int], list[int]]:
    """For each piece its bin and its start there; and the length of each bin.

    ``pieces`` are lengths from 0 to the longest permitted one.  Ties go to the
    piece that comes first and to the bin opened last.
    """
    sizes = sorted(lengths.sizes)
    order = sorted(range(len(pieces)), key=lambda i: -pieces[i])
    left = sum(pieces)
    free: dict[int, list[int]] = {}  # room -> open bins
    rooms = 0  # bit r is set while a bin with room r is open
    bin_of, start, used, opened = [0] * len(pieces), [0] * len(pieces), [], []
    for i in order:
        n = pieces[i]
        at = rooms >> n
        if at:
            room = n + (at & -at).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            # A bin can be filled at most with what is left of the group.
            fits = [s for s in sizes if s >= n]
            room = min(fits, key=lambda s: (lengths.cost(s) / max(min(s, left), 1), s))
            b = len(used)
            used.append(0)
            opened.append(room)
        bin_of[i], start[i] = b, used[b]
        used[b] += n
        left -= n
        room -= n
        free.setdefault(room, []).append(b)
        rooms |= 1 << room
    return bin_of, start, [sizes[bisect_left(sizes, u)] for u in used]


def word_count(text: Column) -> Column:
    """Words between blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _pack_groups(lengths: Lengths):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(frames), ignore_index=True)  # a few groups of bounded size
        for group, rows in held.groupby("grp", sort=True):
            rows = rows.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
            bins, start, sizes = pack(rows["length"].tolist(), lengths)
            yield rows.assign(bin=np.array(bins, np.int64), start=np.array(start, np.int64), capacity=np.array(sizes, np.int64)[bins])

    return run


def pack_rows(df: DataFrame, length: Column, id_col: str = "doc_id", lengths: Lengths = Lengths(), group_pieces: int = 20_000) -> DataFrame:
    """One row per piece: id, piece, first (unit of the text), length, grp, bin, start, capacity.

    ``length`` measures a row, null counting as 0; a row of length 0 is one piece
    of length 0.  A bin is named by grp and bin.  Null and repeated identifiers
    are packed like any others.  Only lengths are shuffled, never texts.
    """
    longest = max(lengths.sizes)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("total"))
    last = F.greatest(F.ceil(F.col("total") / longest).cast("int") - 1, F.lit(0))
    pieces = rows.select("id", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "id", "piece", (F.col("piece").cast("long") * longest).alias("first"),
        F.least(F.col("total") - F.col("piece").cast("long") * longest, F.lit(longest)).alias("length"),
    )
    pieces = stored(pieces, "pieces")
    groups = pieces.count() // group_pieces + 1
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    dealt = dealt.repartition(groups, "grp")
    schema = "id long, piece int, first long, length long, grp int, bin long, start long, capacity long"
    return dealt.mapInPandas(_pack_nonempty(lengths), schema)


def _pack_nonempty(lengths: Lengths):
    run = _pack_groups(lengths)

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = [f for f in frames if len(f)]
        return run(iter(full)) if full else iter(())

    return start


@query("op6_variable_best_fit")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 512, 1024 or 2048 words."""
    docs = read_table(spark, sf_dir, "documents")
    return pack_rows(docs, word_count(F.col("text"))).withColumnRenamed("id", "doc_id")
