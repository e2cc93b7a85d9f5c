"""What running streams report: one row a micro-batch, as a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quern.session import written_table

PROGRESS_SCHEMA = "query string, batch_id long, input_rows long, metric string, count long"
#: Rows that the driver holds before it writes them.
HELD = 1000


class ProgressLog(StreamingQueryListener):
    """Collects input rows and observed metrics of every micro-batch into the table at ``path``.

    Rows with ``metric`` ``input`` count what was read; the others are the columns of
    ``observe`` as ``name.column``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._rows: list[tuple] = []
        self._lock = threading.Lock()
        self._seen: dict[str, int] = {}
        self._ended: set[str] = set()
        self._moved = threading.Condition(self._lock)

    def onQueryStarted(self, event) -> None:
        return None

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.id), p.batchId, p.numInputRows, "input", p.numInputRows)]
        for name, row in p.observedMetrics.items():
            rows += [(str(p.id), p.batchId, p.numInputRows, f"{name}.{column}", int(value or 0)) for column, value in row.asDict().items()]
        with self._moved:
            self._rows += rows
            self._seen[str(p.id)] = p.batchId
            self._moved.notify_all()
            full = len(self._rows) >= HELD
        if full:
            self.save()

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        with self._moved:
            self._ended.add(str(event.id))
            self._moved.notify_all()

    def save(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def finished(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until the last report of a stopped query has come in; reports arrive behind the query's end."""
        with self._moved:
            self._moved.wait_for(lambda: str(query.id) in self._ended, seconds)

    def table(self) -> DataFrame:
        """All reports so far; a batch that was reported twice counts once."""
        self.save()
        rows = written_table(self.spark, self.path)
        rows = self.spark.createDataFrame([], PROGRESS_SCHEMA) if rows is None else rows
        return rows.dropDuplicates(["query", "batch_id", "metric"])
