"""The life of a stream as a table: its start, every batch with what was observed in it, and its end."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("run", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("at", T.StringType()),
    T.StructField("input_rows", T.LongType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("error", T.StringType()),
])
#: Seconds to wait for the last events of a stream that has ended.
DRAIN_SECONDS = 60
OBSERVED = "batch"


class ProgressLog(StreamingQueryListener):
    """Writes the events of the stream of one name below ``path``, one small file for each.

    A file is named by query and batch, so a batch that is run again after a restart replaces its own event.
    """

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.session, self.name, self.path = spark, name, path.rstrip("/")
        self.queries: set[str] = set()
        self.ended = threading.Event()
        self.failure: Exception | None = None

    def _write(self, file: str, **row) -> None:
        try:
            jvm = self.session.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{file}.json")
            out = target.getFileSystem(self.session.sparkContext._jsc.hadoopConfiguration()).create(target, True)
            out.write(bytearray(json.dumps(row).encode()))
            out.close()
        except Exception as reason:  # noqa: BLE001 - told to the caller when the stream has ended
            self.failure = self.failure or reason

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.queries.add(str(event.id))
            self._write(f"{event.id}-{event.runId}-started", event="started", query=str(event.id), run=str(event.runId), at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name == self.name and OBSERVED in progress.observedMetrics:
            seen = progress.observedMetrics[OBSERVED].asDict()
            metrics = {k: float(v) for k, v in seen.items() if v is not None}
            self._write(
                f"{progress.id}-batch-{progress.batchId}", event="progress", query=str(progress.id), run=str(progress.runId), batch=progress.batchId,
                at=progress.timestamp, input_rows=progress.numInputRows, metrics=metrics,
            )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.queries:
            self._write(f"{event.id}-{event.runId}-ended", event="ended", query=str(event.id), run=str(event.runId), error=event.exception)
            self.ended.set()


def run_observed(df: DataFrame, path: str, checkpoint: str, log_path: str, metrics: dict[str, Column]) -> None:
    """Processes all available input of an append query into parquet files, and logs its events under ``log_path``.

    ``metrics`` are aggregates of numbers; they are observed in the pass that writes the rows, so nothing is read twice. Empty batches
    run no pass and have no event. An error of the stream is raised after its end has been logged.
    """
    spark = df.sparkSession
    log = ProgressLog(spark, f"observed-{uuid.uuid4().hex}", log_path)
    spark.streams.addListener(log)
    try:
        observed = df.observe(OBSERVED, *[column.alias(name) for name, column in metrics.items()])
        query = (
            observed.writeStream.format("parquet").outputMode("append").queryName(log.name)
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        try:
            query.awaitTermination()
        finally:
            # events come from a queue of their own, after the stream itself
            drained = log.ended.wait(DRAIN_SECONDS)
    finally:
        spark.streams.removeListener(log)
    if log.failure or not drained:
        raise RuntimeError(f"the events of the stream are not all under {log_path}") from log.failure


def read_progress(spark: SparkSession, log_path: str) -> DataFrame:
    """The events as a table: ``event`` is started, progress or ended; ``metrics`` holds what was observed in a batch."""
    return spark.read.schema(EVENTS).json(log_path)
