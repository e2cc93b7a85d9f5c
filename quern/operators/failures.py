"""Grouping of item errors for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.pinned import pin
from quern.operators.running import top_per_key
from quern.operators.validation import each_error

SHOWN_ITEMS = 3
SHOWN_GROUPS = 10


def error_rows(checked: DataFrame, index: str, *by: str, errors: str = "errors") -> DataFrame:
    """One row per error: element index inside the item's list, field, message.

    ``/items/3/price`` and ``items[3].price`` give field ``price``; an error that
    is not inside a list keeps the index of its row and its whole path.
    """
    exploded = each_error(checked, *by, F.col(index).alias("row_index"), errors=errors)
    path = F.col("path")
    inside = F.regexp_extract(path, r"(?:/|\[)(\d+)(?:\]|/|$)", 1)
    rest = F.regexp_replace(F.regexp_extract(path, r"(?:/|\[)\d+\]?(.*)$", 1), r"^[./]", "")
    listed = F.rlike(path, F.lit(r"[/\[]\d"))
    opened = pin(
        exploded, item=F.when(listed, F.nullif(inside, F.lit("")).cast("bigint")),
        field=F.when(listed & (inside != ""), rest).otherwise(F.ltrim(path, F.lit("/"))),
    )
    return opened.select(*by, F.coalesce("item", "row_index").alias("item"), "field", "message", "row_index")


def group_errors(errors: DataFrame, *by: str, item: str = "item", spread_by: tuple[str, ...] = ()) -> DataFrame:
    """Count and first item indices per (field, message).

    The text names all items up to three, else the first three and how many more.
    Counting combines before the shuffle, and only the first three indices of a
    group are ever collected.  The rows are read twice, so pass a written table
    (``materialize``) when they come from an expensive check.
    """
    keys = [*by, "field", "message"]
    counts = errors.groupBy(*keys).agg(F.count("*").alias("n"))
    first = top_per_key(errors, keys, [F.col(item), *[F.col(c) for c in spread_by]], SHOWN_ITEMS)
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("first_items"))
    joined = counts.join(shown, keys)
    return joined.withColumn("text", group_text(F.col("field"), F.col("message"), F.col("first_items"), F.col("n")))


def group_text(field: Column, message: Column, first_items: Column, n: Column) -> Column:
    named = F.array_join(F.transform(first_items, lambda i: i.cast("string")), ", ")
    more = F.when(n > SHOWN_ITEMS, F.concat(F.lit(", ... and "), (n - SHOWN_ITEMS).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(field, F.lit(": "), message, F.lit(" (items: "), named, more, F.lit(")"))


def top_groups(groups: DataFrame, limit: int = SHOWN_GROUPS) -> DataFrame:
    """The largest groups with a stable order."""
    return groups.orderBy(F.desc("n"), "field", "message").limit(limit)
