"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

quality     rejects documents that the quadratic discriminant scores below 0.5
exact       keeps one document of each normalised text
near        keeps one document of each component of SimHash fingerprints: four-word shingles, links at 4 or fewer differing bits
secrets     replaces found secrets in the texts; every document stays
packing     packs the words of all documents into sequences

All stages but the last return the columns of ``documents``.  The first stage
learns a model and the fourth measures entropy by windows, which SQL does not
express, so there is no ORACLE_SQL; the tests hold every stage against a
brute-force version.

Each stage works on all rows of its predecessor: null and empty texts, repeated
rows, empty tables and columns of any name are handled as its operator states.
quality rejects null and empty texts where the model scores them low; exact and
near count them as one text; secrets leaves them; packing gives them no place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.best_fit import pack_rows, word_count
from quern.llm.content_sort import drop_exact_duplicates
from quern.llm.entropy_scan import redact
from quern.llm.quadratic_quality import drop_low_quality
from quern.llm.shared import delete_table, read_table, scratch, stored
from quern.llm.trie_join import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacted texts; ``n_chars``, where the table has it, follows a text that changed."""
    clean = redact(docs.select(F.struct("*").alias("row"), "text"))
    kept = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in kept:
        same = F.col("text").eqNullSafe(F.col("row")["text"])
        kept["n_chars"] = F.when(same, kept["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[value.alias(name) for name, value in kept.items()])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_rows(docs, word_count(F.col("text"))).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; what a stage read and wrote for itself goes when its rows stand."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as written:
            docs = stored(stage(spark, docs, sf_dir), name)
            made = written.pop()
        if before:
            delete_table(spark, before)
        before = made
    return docs
