"""Checking items: per-row errors, batch split and summary, tags, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.variants import child, set_text
from quern.operators.schema_rules import SchemaRules


def with_errors(df: DataFrame, rules: SchemaRules, doc: str = "item") -> DataFrame:
    """Add ``errors`` (sorted) and ``valid``; one narrow stage.

    ``doc`` should be a stored or pinned column (see ``with_document``).
    """
    return rules.add_errors(df, doc).withColumn("valid", F.size("errors") == 0)


def each_error(checked: DataFrame, *keep: str | Column, errors: str = "errors") -> DataFrame:
    """One row per error: the kept columns, then path, keyword and message."""
    opened = checked.select(*keep, F.explode(errors).alias("e"))
    return opened.select(*[c for c in opened.columns if c != "e"], "e.path", "e.keyword", "e.message")


def attach_results(items: DataFrame, results: DataFrame, index: str, *by: str) -> DataFrame:
    """Outside check results put next to their items by position."""
    return items.join(results, [*by, index], "left")


def error_lines(errors: Column) -> Column:
    """``path: message`` per error."""
    return F.transform(errors, lambda e: F.concat(e["path"], F.lit(": "), e["message"]))


def split_batch(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and invalid rows, both with their original index column.

    Two tables are two reads of ``checked``, so pass a written one (``materialize``).
    """
    return checked.filter("valid").drop("errors", "valid"), checked.filter("not valid").drop("valid")


def batch_summary(checked: DataFrame, *by: str) -> DataFrame:
    return checked.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid")
    )


def tag_invalid(checked: DataFrame) -> DataFrame:
    """Valid rows unchanged; invalid rows carry ``_validation {valid, errors}``."""
    tag = F.struct(F.lit(False).alias("valid"), error_lines(F.col("errors")).alias("errors"))
    return checked.withColumn("_validation", F.when(~F.col("valid"), tag)).drop("errors", "valid")


def item_label(item: Column) -> Column:
    """``id``, else ``name``, else ``unnamed``; empty values do not count."""
    return F.coalesce(set_text(child(item, "id")), set_text(child(item, "name")), F.lit("unnamed"))


def invalid_report(checked: DataFrame, doc: str, index: str, limit: int = 10) -> DataFrame:
    """The first invalid items by index with label and error lines."""
    return (
        checked.filter(~F.col("valid"))
        .select(index, item_label(F.col(doc)).alias("label"), error_lines(F.col("errors")).alias("messages"))
        .orderBy(index)
        .limit(limit)
    )
