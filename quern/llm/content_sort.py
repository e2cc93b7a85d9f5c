"""Exact dedup by sorting contents.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` became
one space.  Sampled splitters range-partition the rows, an external sort puts
equal texts side by side, and each row is compared in full with the one before
it.  The row with the smallest identifier of a run stays.

The sort key is the first characters of the normalised text, its SHA-256 and the
identifier, so that splitters stay short and a text with a third of all rows is
cut between tasks.  A run cut in this way is joined again through the first and
last text of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.registry import query
from quern.llm.shared import BLANKS, read_table, stored

#: Characters of the text in a splitter.
LEAD = 24


def normalised(text: Column) -> Column:
    """The text with one space for each run of blanks; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; at the end, the partition's first and last text."""
    part, run, first, last = TaskContext.get().partitionId(), -1, None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm = batch.column("norm")
        head = np.empty(n, bool)
        head[0] = last is None or last != norm[0].as_py()
        head[1:] = ~pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        runs = run + np.cumsum(head)
        run, last = int(runs[-1]), norm[n - 1].as_py()
        first = norm[0].as_py() if first is None else first
        kept = [batch.column(name) for name in ("row", "id", "sha")]
        yield _rows(kept, part, runs, head, [None] * n)
    if last is not None:
        kept = [pa.nulls(2, t) for t in (batch.schema.field("row").type, pa.int64(), pa.string())]
        yield _rows(kept, part, np.array([0, run]), np.array([True, False]), [first, last])


def _rows(kept: list, part: int, runs: np.ndarray, head: np.ndarray, edge: list) -> pa.RecordBatch:
    arrays = [*kept, pa.array(np.full(len(runs), part, np.int32)), pa.array(runs.astype(np.int64)), pa.array(head), pa.array(edge, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["row", "id", "sha", "part", "run", "head", "edge"])


def sorted_runs(df: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with the run they belong to, and the runs that go on from one partition to the next.

    Rows: row (the input row if ``carry``, else null), id, sha, part, run, head.
    Joined runs: part, run, chain, leads (first run of its chain).
    """
    # The text travels once: inside the row, or alone where no row is carried.
    row = F.struct("*") if carry else F.struct(F.col(text_col))
    named = df.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    keyed = named.select("row", "id", F.substring("norm", 1, LEAD).alias("lead"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    order = [F.col("lead"), F.col("sha"), F.col("id").asc_nulls_last()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    text = normalised(F.col("row")[text_col])
    ordered = ordered.select((F.col("row") if carry else F.lit(None).cast("string")).alias("row"), "id", "sha", text.alias("norm"))
    schema = T.StructType([
        T.StructField("row", ordered.schema["row"].dataType), T.StructField("id", T.LongType()), T.StructField("sha", T.StringType()),
        T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("head", T.BooleanType()),
        T.StructField("edge", T.StringType()),
    ])
    marked = ordered.mapInArrow(_mark_runs, schema)
    if carry:  # a row behind another of its run never stays
        marked = marked.where("head OR edge IS NOT NULL")
    marked = stored(marked, "sorted-runs")
    edges = marked.where("edge IS NOT NULL").select("part", "run", "head", "edge")
    return marked.where("edge IS NULL").drop("edge"), _joined_runs(edges)


def _joined_runs(edges: DataFrame) -> DataFrame:
    """Chains of runs with equal text over neighbouring partitions; two rows a partition at most."""
    first = edges.where("head").select("part", F.col("edge").alias("first"))
    last = edges.where("NOT head").select("part", F.col("run").alias("last_run"), F.col("edge").alias("last"))
    # Only numbers of partitions pass through this one ordered window.
    before = first.select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))
    same = (
        first.join(before, "part").join(last.select(F.col("part").alias("before"), "last"), "before", "left")
        .select("part", F.coalesce(F.col("first") == F.col("last"), F.lit(False)).alias("same"))
    )
    slots = same.join(last.select("part", "last_run"), "part").select("part", F.explode(F.when(
        F.col("last_run") > 0,
        F.array(F.struct(F.lit(0).cast("long").alias("run"), (~F.col("same")).alias("new")), F.struct(F.col("last_run").alias("run"), F.lit(True).alias("new"))),
    ).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("run"), (~F.col("same")).alias("new"))))).alias("s")).select("part", "s.run", "s.new")
    return slots.select("part", "run", F.sum(F.col("new").cast("long")).over(Window.orderBy("part", "run")).alias("chain"), F.col("new").alias("leads"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  Null identifiers come after all others; in a
    group of nothing else keep_id is null and one row is kept.  Repeated rows
    are rows of their own, one of which stays.  Other columns are not read.
    An empty table gives no rows.
    """
    rows, joined = sorted_runs(df, id_col, text_col, carry=False)
    runs = rows.groupBy("part", "run").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    cut = joined.join(runs, ["part", "run"])
    whole = cut.groupBy("chain").agg(F.min("least").alias("c_least"), F.sum("n").alias("c_n"))
    cut = cut.join(whole, "chain").select("part", "run", "c_least", "c_n", "leads")
    found = rows.join(runs, ["part", "run"]).join(cut, ["part", "run"], "left")
    return found.select(
        "id", F.coalesce("c_least", "least").alias("keep_id"), F.coalesce("c_n", "n").alias("group_size"),
        (F.col("head") & F.coalesce("leads", F.lit(True))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    rows, joined = sorted_runs(df, id_col, text_col, carry=True)
    follows = joined.where("NOT leads").select("part", "run")
    return rows.join(follows, ["part", "run"], "left_anti").select("row.*")


@query("op4_content_sort", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return exact_duplicates(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
