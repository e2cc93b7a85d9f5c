"""Writing results: JSON documents per key, text files, exports, the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def document_lines(results: DataFrame, key: str, index: str, item: str, as_list: bool = True) -> DataFrame:
    """Rows ``(key, seq, line)`` that spell one JSON document per key.

    A document is an opening line, one line per item in index order and a closing
    line.  It is never put together in one row: a key may hold any share of the
    results.  ``as_list`` gives ``[...]``, otherwise ``{"key": [...]}``.
    """
    firsts = results.groupBy(key).agg(F.min(index).alias("_first"))
    quoted = F.substring(F.to_json(F.array(F.col(key))), F.lit(2), F.char_length(F.to_json(F.array(F.col(key)))) - 2)
    opening = F.lit("[") if as_list else F.concat(F.lit("{"), quoted, F.lit(":["))
    closing = F.lit("]") if as_list else F.lit("]}")
    ends = firsts.select(key, F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("seq"), opening.alias("line")),
        F.struct(F.lit(LAST).alias("seq"), closing.alias("line")),
    )).alias("_e")).select(key, "_e.seq", "_e.line")
    comma = F.when(F.col(index) == F.col("_first"), "").otherwise(",")
    body = results.join(firsts, key).select(
        key, F.col(index).cast("bigint").alias("seq"), F.concat(comma, F.to_json(F.col(item))).alias("line")
    )
    return body.unionByName(ends)


def write_json_documents(results: DataFrame, path: str, key: str, index: str, item: str, as_list: bool = True) -> None:
    """One folder per key; its files, read in name order, are the document.

    A small key is one file.  A large key is cut by range over several tasks.
    """
    lines = document_lines(results, key, index, item, as_list)
    ordered = lines.repartitionByRange(key, "seq").sortWithinPartitions(key, "seq")
    ordered.select(key, "line").write.mode("overwrite").partitionBy(key).text(path)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """The written lines with their key and file, for checks."""
    return spark.read.text(path).select("*", F.col("_metadata.file_name").alias("file"))


def append_results(results: DataFrame, path: str, key: str) -> None:
    """Results of one task added below their key; later tasks add to the same key."""
    results.write.mode("append").partitionBy(key).parquet(path)


def numbered_name(name: Column, index: Column) -> Column:
    """``{index}`` counted from 1; without it the number goes before the extension,
    so results never overwrite one another."""
    number = (index + 1).cast("string")
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^./]*)$", 1)
    stem = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext))
    mark = F.locate("{index}", name)
    placed = F.concat(F.substring(name, F.lit(1), mark - 1), number, F.substring(name, mark + 7, F.char_length(name)))
    return F.when(mark > 0, placed).otherwise(F.concat(stem, F.lit("_"), number, ext))


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def append_history(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def export(rows: DataFrame, path: str, kind: str) -> None:
    """jsonl, csv, tsv, xml or text (one string column)."""
    writer = rows.write.mode("overwrite")
    if kind == "jsonl":
        writer.json(path)
    elif kind in ("csv", "tsv"):
        writer.option("header", True).option("escape", '"').option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind == "xml":
        writer.option("rowTag", "row").option("rootTag", "rows").format("xml").save(path)
    elif kind == "text":
        writer.text(path)
    else:
        raise ValueError(f"unknown export: {kind}")
