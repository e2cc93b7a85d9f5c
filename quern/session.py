"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Runtime SQL settings every job of this package relies on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # No job uses a broadcast hint: Spark broadcasts a side only when its size,
    # estimated or measured at runtime, is below autoBroadcastJoinThreshold, and
    # splits the hot partitions of the shuffled joins that remain.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stream state lives on disk, so it may outgrow executor memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Session windows merge inside each map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "quern", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read and write.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    session, where every task runs on this machine, may fall back to a fresh
    temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="quern-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a task of heavy per-row work.
SPREAD_ROWS = 50_000


def spread(df):
    """Rows of a few input files dealt out to all cores, or to more tasks where they would be long; other inputs stay as they are.

    A file read as a single row group is a single task, which heavy per-row work
    would keep waiting for.  A task has about ``SPREAD_ROWS`` rows, however large
    the table is.  Tables of at least as many files as that makes tasks are already
    spread and are not shuffled.  The count reads the footers of the files alone.
    """
    tasks, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    tasks = max(tasks, -(-df.count() // SPREAD_ROWS))
    return df.repartition(tasks) if files < tasks else df


def written_table(spark: SparkSession, path: str):
    """The Parquet table at ``path``, or None where nothing was written; every other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def materialize(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where a result must not be computed twice (inference answers) or where
    several consumers share an expensive lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
