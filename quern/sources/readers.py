"""Reading configurations, items, schemas, catalogues, ledgers and file trees."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.pinned import pin
from quern.functions.text import base_name, dir_name, extension
from quern.functions.variants import as_array, parse_exact


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row per file: path, text, ``doc`` and whether it is valid JSON."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    rows = files.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return with_document(rows)


def with_document(rows: DataFrame, text: str = "text") -> DataFrame:
    """Parse a JSON text column; bad rows stay with ``parse_ok`` false."""
    return with_json(rows, F.col(text), "doc").withColumn("parse_ok", F.col("doc").isNotNull())


def with_json(rows: DataFrame, text: Column, name: str = "item") -> DataFrame:
    """Add the VARIANT of a JSON text, parsed once per row."""
    return pin(rows, **{name: parse_exact(text)})


def read_config(spark: SparkSession, path: str) -> dict:
    """One configuration for the driver; a missing file or bad JSON is an error."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(f"Config file not found: {path}")
    try:
        return json.loads(rows[0].value)
    except ValueError as error:
        raise ValueError(f"Invalid JSON in file: {path}") from error


def read_schema(spark: SparkSession, path: str) -> dict:
    """A schema file, or the schema inside a configuration file."""
    loaded = read_config(spark, path)
    return loaded["schema"] if isinstance(loaded.get("schema"), dict) else loaded


def items_of(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per item with its index: the elements of a list, or the document itself."""
    value = F.col(doc)
    elements = as_array(value)
    items = F.when(elements.isNotNull(), elements).when(value.isNotNull(), F.array(value))
    kept = [c for c in documents.columns if c != doc]
    return documents.select(*kept, F.posexplode(items).alias("index", "item"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON files that hold a list or one object."""
    return items_of(read_documents(spark, path).filter("parse_ok")).select("path", "index", "item")


def read_item_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON Lines files; these split, so they are the form for large sets."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return with_document(rows.withColumnRenamed("value", "text")).withColumnRenamed("doc", "item")


MODEL_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("context_length", T.LongType()),
    T.StructField("created", T.LongType()),
    T.StructField("pricing", T.StructType([
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("web_search", T.StringType()),
    ])),
    T.StructField("architecture", T.StructType([
        T.StructField("input_modalities", T.ArrayType(T.StringType())),
        T.StructField("output_modalities", T.ArrayType(T.StringType())),
        T.StructField("tokenizer", T.StringType()),
    ])),
    T.StructField("top_provider", T.StructType([
        T.StructField("max_completion_tokens", T.LongType()),
        T.StructField("is_moderated", T.BooleanType()),
        T.StructField("name", T.StringType()),
    ])),
    T.StructField("supported_parameters", T.ArrayType(T.StringType())),
])


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Raw model records from JSON, with the schema given, not inferred."""
    return spark.read.schema(MODEL_SCHEMA).json(path)


def read_ledger(spark: SparkSession, path: str, json_columns: tuple[str, ...] = ("errors", "output_files", "metadata")) -> DataFrame:
    """Ledger rows with their JSON texts parsed."""
    rows = spark.read.parquet(path)
    for name in json_columns:
        if name in rows.columns:
            rows = rows.withColumn(name, parse_exact(F.col(name)))
    return rows


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, name, extension, size, modified. No content is read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    name = base_name(F.col("path"))
    return files.select(
        "path", name.alias("name"), dir_name(F.col("path")).alias("folder"), extension(name).alias("extension"), "size", "modified",
        (F.lower(extension(name)) == ".json").alias("is_json"),
    )


def ordered_messages(rows: DataFrame, *kept: str) -> DataFrame:
    """Conversation rows ``(conv_id, turn, role, text)``, whatever their role."""
    return rows.select("conv_id", "turn", "role", "text", *kept)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A stream reads a folder or a glob; this glob matches only the very name, be it a file or a folder.
    name = path.rstrip("/")
    return reader.parquet(f"{name[:-1]}[{name[-1]}]")


