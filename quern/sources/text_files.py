"""Text results under their own names: a data source that writes one file a row.

Tasks write below a staging folder beside the target, each file under a name of
the task first, so a file is whole or not there.  When all tasks are done the job
compares the number of files with the number of rows and puts the staging folder
in the place of the target (``overwrite``), or moves the files over (``append``).
A task that fails takes its files with it, a job that fails takes its folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_text_files"


@dataclass
class Written(WriterCommitMessage):
    files: int


class TextFiles(DataSource):
    """``file_name string, content string``; null contents are empty files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TextFilesWriter(self.options["path"], overwrite)


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    @staticmethod
    def _opened(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = self._opened(self.staging)
        store.create_dir(folder, recursive=True)
        mine, done = f"{folder}/.part-{uuid.uuid4().hex}", []
        try:
            for row in iterator:
                name = checked_name(row["file_name"])
                with store.open_output_stream(mine) as out:
                    out.write((row["content"] or "").encode())
                store.move(mine, f"{folder}/{name}")
                done.append(name)
        except BaseException:
            for name in [mine.rsplit("/", 1)[1], *done]:
                try:
                    store.delete_file(f"{folder}/{name}")
                except FileNotFoundError:
                    continue
            raise
        return Written(len(done))

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._opened(self.staging)
        _, target = self._opened(self.path)
        store.create_dir(folder, recursive=True)  # a table without rows
        files = [f for f in store.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(".")]
        rows = sum(m.files for m in messages if m)
        if len(files) != rows:
            store.delete_dir(folder)
            raise ValueError(f"{rows} rows have {len(files)} file names")
        if self.overwrite or store.get_file_info(target).type == fs.FileType.NotFound:
            if store.get_file_info(target).type != fs.FileType.NotFound:
                store.delete_dir(target)
            store.move(folder, target)
            return
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: store.move(f.path, f"{target}/{f.base_name}"), files))
        store.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._opened(self.staging)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def checked_name(name: str | None) -> str:
    """A plain file name; anything that would leave the folder, or hide in it, is an error."""
    if not name or "/" in name or "\0" in name or name.startswith("."):
        raise ValueError(f"not a file name: {name!r}")
    return name


def write_text_files(rows: DataFrame, path: str, name: str = "file_name", content: str = "content", mode: str = "overwrite") -> None:
    """The file ``path/<name>`` for every row, written where the rows are; names must differ."""
    rows.sparkSession.dataSource.register(TextFiles)
    named = rows.select(F.col(name).cast("string").alias("file_name"), F.col(content).cast("string").alias("content"))
    named.write.format(FORMAT).mode(mode).save(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name`` and ``content`` of the files at ``path``; Spark passes over empty ones."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode(F.col("content"), "UTF-8").alias("content"))
