"""Queries over files and outputs: listings, folders, documents, text files, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.display import bytes_text_short
from quern.functions.text import base_name, dir_name, error_excerpt, extension, preview, safe_file_name
from quern.operators import files
from quern.plans.registry import query
from quern.plans.tables import table
from quern.session import scratch_path, spread
from quern.sources.readers import read_inventory
from quern.sources.text_files import read_text_files, write_text_files
from quern.sources.writers import (
    append_results, export, numbered_name, pretty_json, read_json_documents, write_json_documents,
)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: path from the URL without scheme, size of the HTML."""
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return p.select("page_id", path.alias("path"), F.char_length("html").cast("bigint").alias("size"), "html")


PATH_SQL = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query("folder_size", f"""
    WITH p AS (SELECT string_split({PATH_SQL}, '/') AS parts, length(html) AS size FROM pages),
      f AS (SELECT array_to_string(parts[1:n], '/') AS folder, size FROM p, unnest(range(len(parts))) AS r(n))
    SELECT folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM f GROUP BY 1
""")
def folder_size(spark, sf_dir):
    return files.folder_sizes(page_files(spark, sf_dir))


@query("file_listing", f"""
    WITH p AS (SELECT page_id, {PATH_SQL} AS path, length(html) AS size, html FROM pages),
    l AS (SELECT *, string_split(path, '/')[-1] AS name FROM p)
    SELECT page_id, name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder,
      regexp_extract(name, '^.+(\\.[^.]*)$', 1) AS extension,
      CASE WHEN lower(string_split(name, '.')[-1]) = 'html' THEN 'html' ELSE 'text' END AS class,
      CASE WHEN regexp_extract(name, '^.+(\\.[^.]*)$', 1) = '.html' THEN 'text/html' ELSE 'text/plain' END AS content_type,
      true AS safe, contains(lower(name), '8') AS found, NOT contains(html, chr(65533)) AS is_text,
      '/data/u1/' || path AS planned, regexp_replace(path, '[^a-zA-Z0-9.-]', '_', 'g') AS safe_name,
      CASE WHEN length(html) > 80 THEN substr(html, 1, 80) || '...' ELSE html END AS preview, substr(html, 1, 200) AS excerpt
    FROM l
""")
def file_listing(spark, sf_dir):
    rows = files.as_listing(page_files(spark, sf_dir))
    return rows.select(
        "page_id", "name", dir_name(F.col("path")).alias("folder"), "extension", files.file_class(F.col("name")).alias("class"),
        files.content_type(F.col("name")).alias("content_type"), files.safe_path(F.col("path")).alias("safe"),
        files.matches_name(F.col("name"), "8").alias("found"), files.shows_as_text(F.col("name"), F.col("html")).alias("is_text"),
        files.planned_path(F.lit("/data/u1"), F.lit("."), F.col("path")).alias("planned"),
        safe_file_name(F.col("path")).alias("safe_name"), preview(F.col("html")).alias("preview"),
        error_excerpt(F.col("html")).alias("excerpt"),
    )


@query("folder_listing", f"""
    WITH p AS (SELECT {PATH_SQL} AS path, length(html) AS size FROM pages),
      f AS (SELECT path, true AS is_dir, CAST(NULL AS BIGINT) AS size FROM (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM p)
        UNION ALL SELECT path, false, size FROM p)
    SELECT path, is_dir, size FROM f ORDER BY is_dir DESC, size DESC, path
""")
def folder_listing(spark, sf_dir):
    """Folders first, then files by size."""
    pages = page_files(spark, sf_dir).select("path", "size")
    folders = pages.select(dir_name(F.col("path")).alias("path")).distinct()
    rows = pages.withColumn("is_dir", F.lit(False)).unionByName(folders.withColumn("is_dir", F.lit(True)), allowMissingColumns=True)
    listed = files.as_listing(rows)
    return listed.orderBy(*files.listing_order("size", descending=True)).select("path", "is_dir", "size")


@query("file_inventory", """
    SELECT lang AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS all_text FROM documents GROUP BY 1
""")
def file_inventory(spark, sf_dir):
    """Documents written as text below one folder per language, then listed by size."""
    path = scratch_path(spark, "tree")
    table(spark, sf_dir, "documents", "lang", "text").write.partitionBy("lang").text(path)
    listed = read_inventory(spark, path).filter(F.startswith("name", F.lit("part-")))
    return listed.groupBy(F.regexp_extract("folder", "lang=([^/]+)", 1).alias("folder")).agg(
        F.sum("size").cast("bigint").alias("bytes"), F.min(F.col("extension") == ".txt").alias("all_text")
    )


@query("copy_missing", "SELECT s_suppkey, s_name FROM supplier WHERE s_name NOT IN (SELECT replace(c_name, 'Customer', 'Supplier') FROM customer WHERE c_nationkey < 12)")
def copy_missing(spark, sf_dir):
    source = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    target = table(spark, sf_dir, "customer", "c_name", "c_nationkey").filter("c_nationkey < 12")
    names = target.select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("s_name"))
    return files.copy_if_missing(source, names, "s_name").select("s_suppkey", "s_name")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per task key: customers as items of their nation."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    return c.select(
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("task_key"), F.col("c_custkey").alias("index"),
        F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("item"),
    )


@query("json_docs", """
    WITH i AS (SELECT 'nation_' || c_nationkey AS task_key, c_custkey, '{"id":' || c_custkey || ',"name":"' || c_name || '"}' AS item FROM customer),
    d AS (
      SELECT task_key, 'list' AS kind, '[' || string_agg(item, ',' ORDER BY c_custkey) || ']' AS doc, count(*) AS items FROM i GROUP BY 1
      UNION ALL SELECT task_key, 'object', '{"' || task_key || '":[' || string_agg(item, ',' ORDER BY c_custkey) || ']}', count(*) FROM i GROUP BY 1
    )
    SELECT task_key, kind, items, CAST(length(doc) AS BIGINT) AS chars, CAST(items + 2 AS BIGINT) AS lines FROM d
""")
def json_docs(spark, sf_dir):
    results, out = _results(spark, sf_dir), None
    for kind, as_list in (("list", True), ("object", False)):
        path = scratch_path(spark, "documents")
        write_json_documents(results, path, "task_key", "index", "item", as_list)
        lines = read_json_documents(spark, path)
        part = lines.groupBy("task_key").agg(
            F.count_if(F.rlike("value", F.lit(r'^,?\{"id":'))).alias("items"), F.sum(F.char_length("value")).cast("bigint").alias("chars"),
            F.count("*").alias("lines"),
        ).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("text_files", """
    SELECT 'Supplier_' || s_suppkey || '_' || (s_suppkey + 1) || '.md' AS file_name, 'about ' || s_name || chr(10) || 'second line' AS content FROM supplier
""")
def text_files(spark, sf_dir):
    s = spread(table(spark, sf_dir, "supplier", "s_suppkey", "s_name"))
    name = F.concat(F.lit("Supplier_"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "_{index}.md").otherwise(".md"))
    rows = s.select(
        safe_file_name(numbered_name(name, F.col("s_suppkey"))).alias("file_name"),
        F.concat(F.lit("about "), F.col("s_name"), F.lit("\nsecond line")).alias("content"),
    )
    path = scratch_path(spark, "texts")
    write_text_files(rows, path)
    return read_text_files(spark, path)


@query("exports", """
    SELECT kind, s_suppkey, s_name, s_acctbal FROM supplier, (VALUES ('jsonl'), ('csv'), ('tsv'), ('xml'), ('append')) AS k(kind)
""")
def exports(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    schema, out = s.schema, None
    for kind in ("jsonl", "csv", "tsv", "xml"):
        path = scratch_path(spark, kind)
        export(s, path, kind)
        reader = spark.read.schema(schema)
        back = {
            "jsonl": lambda p, r=reader: r.json(p),
            "csv": lambda p, r=reader: r.option("header", True).csv(p),
            "tsv": lambda p, r=reader: r.option("header", True).option("sep", "\t").csv(p),
            "xml": lambda p, r=reader: r.option("rowTag", "row").format("xml").load(p),
        }[kind](path)
        part = back.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    path = scratch_path(spark, "append")
    keyed = s.withColumn("task_key", F.when(F.col("s_acctbal") > 0, "rich").otherwise("poor"))
    append_results(keyed.filter("s_suppkey < 50"), path, "task_key")
    append_results(keyed.filter("s_suppkey >= 50"), path, "task_key")
    return out.unionByName(spark.read.parquet(path).drop("task_key").withColumn("kind", F.lit("append")))


@query("pretty_json", """
    SELECT s_suppkey, '{' || chr(10) || '  "id" : ' || s_suppkey || ',' || chr(10) || '  "name" : "' || s_name || '"' || chr(10) || '}' AS text FROM supplier
""")
def pretty(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return s.select("s_suppkey", pretty_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("text"))


@query("size_labels", """
    SELECT doc_id, CASE WHEN n_chars = 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%.1f', CAST(n_chars AS DOUBLE)) || ' B'
      ELSE printf('%.1f', CAST(round(n_chars / 1024e0, 1) AS DOUBLE)) || ' KB' END AS size,
      'doc' || doc_id || '.txt' AS name, '.txt' AS ext
    FROM documents
""")
def size_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    path = F.concat(F.lit("a/b/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", bytes_text_short(F.col("n_chars")).alias("size"), base_name(path).alias("name"), extension(path).alias("ext"))
