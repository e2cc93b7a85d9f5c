"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions stay where they are.

    Spark copies the expression of an ordinary derived column into every filter
    and projection above it that it can push or merge, so a parsed document
    would be parsed once per rule.  The output of a generator is not copied:
    each row is exploded from a one-element array.  Pin values, not structs of
    which only one field is used: Spark would pull that field out and copy it.
    """
    kept = [c for c in df.columns if c not in columns]
    # The projection below is compiled and shares subexpressions; a generator
    # evaluates its own input one node at a time, so it only gets a reference.
    built = df.select(*kept, *[v.alias(f"_pin_{k}") for k, v in columns.items()])
    box = F.struct(*[F.col(f"_pin_{k}").alias(k) for k in columns])
    return built.select(*kept, F.explode(F.array(box)).alias("_pin")).select(*kept, *[F.col(f"_pin.{k}").alias(k) for k in columns])
