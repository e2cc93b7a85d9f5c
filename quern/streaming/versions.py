"""Keyed tables that streams write: one small folder a batch, merged from time to time.

A batch writes only the rows whose keys changed, to ``batch=N``.  When batch N
begins, folders of earlier batches, all of them committed, are merged into
``base=N-1`` once there are more than ``every``: the newest version of each key
remains, so the size on disk follows the keys and not the batches.  A base counts
from the moment its job has marked it as done; what it replaces is deleted after
that, so a failure at any point leaves a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 8


class VersionedTable:
    """The table at ``path``, one row for each value of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], every: int = EVERY):
        self.spark, self.path, self.keys, self.every = spark, path.rstrip("/"), keys, every

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            return []
        names = [f.getPath() for f in store.listStatus(at)]
        done = [p.getName() for p in names if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{kind}="))

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Add the changed rows of a batch; a batch that runs again replaces its own."""
        changed.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def begin(self, batch_id: int) -> None:
        """Merge the folders of earlier batches if they are many; before a batch reads or writes the table."""
        last = batch_id - 1
        base = max(self._folders("base"), default=-1)
        mine = [b for b in self._folders("batch") if base < b <= last]
        if len(mine) > self.every:
            self.read(before=last + 1).write.mode("overwrite").parquet(f"{self.path}/base={last}")
            base = last
        for kind in ("batch", "base"):  # also what an earlier merge could not delete any more
            for number in self._folders(kind):
                if number < base or (kind == "batch" and number == base):
                    self._delete(f"{kind}={number}")

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version of every row, of batches below ``before`` alone if it is given; None where there is none."""
        base = max(self._folders("base"), default=None)
        batches = [b for b in self._folders("batch") if (base is None or b > base) and (before is None or b < before)]
        parts = [self.spark.read.parquet(f"{self.path}/batch={b}").withColumn("_version", F.lit(b)) for b in batches]
        if base is not None:
            parts.append(self.spark.read.parquet(f"{self.path}/base={base}").withColumn("_version", F.lit(-1)))
        if not parts:
            return None
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        values = [c for c in rows.columns if c not in (*self.keys, "_version")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_version").alias("_w"))
        return newest.select(*self.keys, "_w.*")
