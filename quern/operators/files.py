"""File listings: classes, folders, sizes, order, path safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import base_name, extension

# File classes by extension.
CLASSES = {
    "json": ("json",),
    "markdown": ("md", "markdown"),
    "javascript": ("js", "ts", "jsx", "tsx"),
    "python": ("py",),
    "sql": ("sql",),
    "css": ("css",),
    "html": ("html",),
    "xml": ("xml",),
    "csv": ("csv",),
    "text": ("txt", "log"),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "ico"),
    "binary": ("pdf", "zip", "rar", "exe", "dll", "mp3", "mp4", "avi"),
}

# Content types by extension.
CONTENT_TYPES = {
    ".json": "application/json",
    ".csv": "text/csv",
    ".html": "text/html",
    ".css": "text/css",
    ".js": "text/javascript",
    ".xml": "text/xml",
    ".sql": "text/plain",
    ".md": "text/markdown",
}


def file_class(name: Column) -> Column:
    """Class by the part after the last dot; unknown means text."""
    ext = F.lower(F.substring_index(name, ".", -1))
    out = None
    for kind, exts in CLASSES.items():
        out = F.when(ext.isin(*exts), kind) if out is None else out.when(ext.isin(*exts), kind)
    return out.otherwise("text")


def content_type(name: Column) -> Column:
    ext = F.lower(extension(name))
    out = None
    for key, kind in CONTENT_TYPES.items():
        out = F.when(ext == key, kind) if out is None else out.when(ext == key, kind)
    return out.otherwise("text/plain")


def shows_as_text(name: Column, content: Column) -> Column:
    """Not an image or binary by name, and no replacement character inside."""
    return ~file_class(name).isin("image", "binary") & ~F.contains(content, F.lit("�"))


def valid_text(content: Column) -> Column:
    """Whether raw bytes are UTF-8 and hold no replacement character."""
    text = F.try_validate_utf8(content)
    return text.isNotNull() & ~F.contains(F.coalesce(text, F.lit("")), F.lit("�"))


def safe_path(path: Column) -> Column:
    """Relative, without a parent step."""
    return ~F.contains(path, F.lit("..")) & ~F.startswith(path, F.lit("/")) & ~F.rlike(path, F.lit(r"^[A-Za-z]:[\\/]"))


def planned_path(user_dir: Column, output: Column, name: Column) -> Column:
    """Absolute output folders are kept, relative ones go below the user's."""
    absolute = F.startswith(output, F.lit("/"))
    folder = F.when(absolute, output).otherwise(F.concat(user_dir, F.lit("/"), output))
    return F.regexp_replace(F.concat(folder, F.lit("/"), name), r"/(?:\.?/)+", "/")


def matches_name(name: Column, query: str) -> Column:
    return F.contains(F.lower(name), F.lit(query.lower())) if query else F.lit(True)


def folder_sizes(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Total size and file count of every folder, nested files included.

    Each file is counted for all its parent folders, combined map side; the
    root folder is the empty text.
    """
    parts = F.split(F.col(path), "/")
    depth = F.size(parts)
    folders = F.transform(
        F.sequence(F.lit(0), depth - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    rows = files.select(F.explode(folders).alias("folder"), F.col(size).alias("_size"))
    return rows.groupBy("folder").agg(F.sum("_size").cast("bigint").alias("bytes"), F.count("*").alias("files"))


def listing_order(by: str = "name", descending: bool = False) -> list[Column]:
    """Folders first, then by name, date, size or type; the path breaks ties."""
    key = {
        "name": F.lower("name"), "date": F.col("modified"), "size": F.coalesce(F.col("size"), F.lit(0)),
        "type": F.coalesce(F.col("extension"), F.lit("")),
    }[by]
    return [F.desc("is_dir"), key.desc() if descending else key.asc(), F.asc("path")]


def as_listing(files: DataFrame, path: str = "path") -> DataFrame:
    """Add name, extension and is_json to rows with a path."""
    name = base_name(F.col(path))
    return files.withColumn("name", name).withColumn("extension", extension(name)).withColumn(
        "is_json", F.lower(extension(name)) == ".json"
    )


def copy_if_missing(source: DataFrame, target: DataFrame, name: str = "name") -> DataFrame:
    """Files of the source whose name the target does not have."""
    return source.join(target.select(name).distinct(), name, "left_anti")
