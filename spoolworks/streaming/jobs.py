"""Device telemetry and training logs as streams.

Each job is the streaming twin of a batch aggregate: same grouping, same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import log_line
from ..operators.metrics import running_mean
from ..sources.files import is_folder


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 1000
) -> DataFrame:
    """New files of a folder as a stream, a bounded number per micro-batch.

    The path of one file streams that file: the source is then its folder, filtered to its name.
    """
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    if is_folder(spark, path):
        return reader.load(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).load(folder)


def gpu_windows(samples: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and peak device memory per window; on a stream, rows later than ``late`` are dropped."""
    if samples.isStreaming:
        samples = samples.withWatermark("ts", late)
    return (
        samples.groupBy(F.window("ts", every).alias("w"), "gpu")
        .agg(
            F.avg("allocated_gb").alias("mean_gb"),
            F.max("allocated_gb").alias("peak_gb"),
            F.count(F.lit(1)).alias("samples"),
        )
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "gpu", "mean_gb", "peak_gb", "samples")
    )


def metric_lines(log: DataFrame, names: list[str], step: str = "step") -> DataFrame:
    """``Step n: name: value - ...`` for every log row; stateless, so the same on a stream."""
    return log.withColumn("line", F.concat(F.lit("Step "), F.col(step).cast("string"), F.lit(": "), log_line(log, names)))


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all available input of an append query into parquet files, then stops."""
    query = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_running_means(log: DataFrame, path: str, checkpoint: str, run: str = "run") -> None:
    """Running mean per run in update mode.

    A micro-batch writes the runs it changed under its own batch number, overwriting that
    number only, so a repeated batch leaves the same files.
    """

    def write_batch(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (
        running_mean(log, run).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(write_batch)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_means(spark: SparkSession, path: str, run: str = "run") -> DataFrame:
    """The newest running mean of every run."""
    written = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return written.groupBy(run).agg(
        F.max_by("mean_loss", "batch").alias("mean_loss"), F.max_by("logged", "batch").alias("logged")
    )
