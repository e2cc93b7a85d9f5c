"""Driver tables, and the domain tables Spark derives from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.catalog import project_models

NOW = datetime(2024, 1, 31, 12, 30, 45, 678000)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def event_props(column: str = "props") -> Column:
    """The number inside an event's JSON properties."""
    return F.get_json_object(F.col(column), "$.k").cast("bigint")


def raw_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model records as a provider lists them, one per part."""
    p = table(spark, sf_dir, "part")
    stem = (
        F.when(F.col("p_type") == "ECONOMY", "openai/gpt-4-")
        .when(F.col("p_type") == "LARGE", "anthropic/claude-3.5-")
        .when(F.col("p_type") == "MEDIUM", "google/gemini-flash-")
        .when(F.col("p_type") == "PROMO", "meta-llama/llama-3.1-8b-")
        .when(F.col("p_type") == "SMALL", "mistralai/mixtral-")
        .otherwise("perplexity/sonar-")
    )
    size = F.col("p_size")
    free = F.col("p_brand") == "Brand#1"
    modalities = (
        F.when(F.col("p_type").isin("ECONOMY", "LARGE"), F.array(F.lit("text"), F.lit("image")))
        .when(F.col("p_type") == "MEDIUM", F.array(F.lit("text"), F.lit("audio")))
        .otherwise(F.array(F.lit("text")))
    )
    parameters = F.array_compact(F.array(
        F.lit("stream"), F.when(size > 25, "tools"), F.when(size < 40, "response_format"), F.when(size > 45, "reasoning"),
    ))
    return p.select(
        F.concat(stem, F.col("p_partkey").cast("string"), F.when(size == 50, ":free").otherwise("")).alias("id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        (size * 4000).cast("bigint").alias("context_length"),
        F.when(size > 5, F.lit(1_600_000_000) + F.col("p_partkey") * 1000).alias("created"),
        F.struct(
            F.when(free, 0.0).otherwise(size / 20_000_000.0).alias("prompt"),
            F.when(free, 0.0).otherwise(size / 10_000_000.0).alias("completion"),
        ).alias("pricing"),
        F.struct(modalities.alias("input_modalities")).alias("architecture"),
        F.struct(
            (size * 100).cast("bigint").alias("max_completion_tokens"), (F.col("p_retailprice") > 950).alias("is_moderated")
        ).alias("top_provider"),
        parameters.alias("supported_parameters"),
        "p_partkey",
    )


def models(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    return project_models(raw_models(spark, sf_dir), *kept)




MODELS_SQL = """
models AS (
  SELECT
    CASE p_type WHEN 'ECONOMY' THEN 'openai/gpt-4-' WHEN 'LARGE' THEN 'anthropic/claude-3.5-'
      WHEN 'MEDIUM' THEN 'google/gemini-flash-' WHEN 'PROMO' THEN 'meta-llama/llama-3.1-8b-'
      WHEN 'SMALL' THEN 'mistralai/mixtral-' ELSE 'perplexity/sonar-' END
      || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size = 50 THEN ':free' ELSE '' END AS id,
    p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name,
    CAST(p_size * 4000 AS BIGINT) AS context_length,
    CASE WHEN p_size > 5 THEN 1600000000 + p_partkey * 1000 END AS created,
    CASE WHEN p_brand = 'Brand#1' THEN 0e0 ELSE p_size / 2e7 END AS prompt,
    CASE WHEN p_brand = 'Brand#1' THEN 0e0 ELSE p_size / 1e7 END AS completion,
    p_type IN ('ECONOMY', 'LARGE') AS image,
    p_type = 'MEDIUM' AS audio,
    p_size > 25 AS tools,
    p_size < 40 AS response_format,
    p_size > 45 AS reasoning,
    CAST(p_size * 100 AS BIGINT) AS max_completion_tokens,
    p_retailprice > 950 AS is_moderated,
    p_type = 'STANDARD' AS native,
    p_partkey
  FROM part
)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of runs, from order lines: tokens, model, error."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return line.select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("index"),
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_quantity").cast("bigint").alias("prompt_tokens"),
        (F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("completion_tokens"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"),
        F.when(F.col("l_returnflag") == "R", "Request timeout").alias("error"),
    )
