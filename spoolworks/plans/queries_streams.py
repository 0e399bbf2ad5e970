"""Queries that run as streams over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.registry import batch_hook
from ..session import scratch_path
from ..streaming import jobs as J
from ..streaming.progress import read_progress, run_observed
from ..streaming.saves import save_events, saves_of
from .catalog import query
from .queries_metrics import r, settled
from .standins import V_GPU, gpu_samples


def event_stream(t):
    return J.stream_files(t.spark, f"{t.folder}/events.parquet", t.table("events").schema)


@query(
    "stream_gpu_windows",
    f"""SELECT start, "end", gpu, {r('avg(allocated_gb)')} AS mean_gb, max(allocated_gb) AS peak_gb, count(*) AS samples
        FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS "end",
                     gpu, allocated_gb FROM v_gpu) q
        WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM v_gpu) GROUP BY start, "end", gpu""",
    (V_GPU,),
)
def _(t):
    """Append mode: windows still open under the watermark are not out yet."""
    out = scratch_path(t.spark, "windows")
    windows = J.gpu_windows(gpu_samples(event_stream(t)))
    J.run_available(windows, f"{out}/rows", f"{out}/checkpoint")
    rows = t.spark.read.parquet(f"{out}/rows")
    return rows.select(
        F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "gpu",
        settled(F.col("mean_gb")).alias("mean_gb"), "peak_gb", "samples",
    )


@query(
    "batch_gpu_windows",
    f"""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS "end", gpu,
               {r('avg(allocated_gb)')} AS mean_gb, max(allocated_gb) AS peak_gb, count(*) AS samples FROM v_gpu GROUP BY 1, 2, 3""",
    (V_GPU,),
)
def _(t):
    rows = J.gpu_windows(t.gpu)
    return rows.select(
        F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "gpu",
        settled(F.col("mean_gb")).alias("mean_gb"), "peak_gb", "samples",
    )


def log_stream(t):
    return event_stream(t).select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.col("value") / 100).alias("loss")
    )


@query(
    "stream_metric_log",
    f"SELECT user_id AS run, {r('avg(value / 100)')} AS mean_loss, count(value) AS logged FROM events GROUP BY user_id",
)
def _(t):
    out = scratch_path(t.spark, "means")
    J.run_running_means(log_stream(t), f"{out}/rows", f"{out}/checkpoint")
    latest = J.latest_means(t.spark, f"{out}/rows")
    return latest.withColumn("mean_loss", settled(F.col("mean_loss")))


@query(
    "stream_metric_lines",
    "SELECT user_id AS run, event_id AS step, concat('Step ', event_id, ': loss: ', printf('%.4f', value / 100)) AS line FROM events",
)
def _(t):
    out = scratch_path(t.spark, "lines")
    lines = J.metric_lines(log_stream(t), ["loss"]).select("run", "step", "line")
    J.run_available(lines, f"{out}/rows", f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/rows")


@query("event_hooks", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    """Two hooks on every micro-batch: one keeps the rows, one keeps the counts."""
    out = scratch_path(t.spark, "hooks")

    def keep_rows(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    def keep_counts(batch, number):
        counts = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    stream = event_stream(t).writeStream.foreachBatch(batch_hook(keep_rows, keep_counts))
    stream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    counts = t.spark.read.parquet(f"{out}/counts")
    return counts.groupBy("event_type").agg(F.sum("n").alias("n"))


@query(
    "stream_progress",
    """SELECT event, n_events, n_rows, n_users FROM (
         SELECT 'progress' AS event, 4 AS n_events, CAST(count(*) AS DOUBLE) AS n_rows, CAST(sum(user_id) AS DOUBLE) AS n_users FROM events
         UNION ALL SELECT 'started', 1, NULL, NULL UNION ALL SELECT 'ended', 1, NULL, NULL) q""",
)
def _(t):
    """Four files, a batch each: what was observed in the batches adds up to the table."""
    out = scratch_path(t.spark, "observed")
    t.table("events").select("user_id").repartition(4).write.parquet(f"{out}/in")
    stream = J.stream_files(t.spark, f"{out}/in", t.table("events").select("user_id").schema, max_files=1)
    observed = {"rows": F.count(F.lit(1)), "users": F.sum("user_id")}
    run_observed(stream, f"{out}/rows", f"{out}/checkpoint", f"{out}/log", observed)
    return read_progress(t.spark, f"{out}/log").groupBy("event").agg(
        F.count(F.lit(1)).cast("int").alias("n_events"), F.sum(F.col("metrics")["rows"]).alias("n_rows"), F.sum(F.col("metrics")["users"]).alias("n_users")
    )


@query(
    "stream_saves",
    """SELECT user_id AS run, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3 AS kept
       FROM events WHERE event_id % 10 = 0""",
)
def _(t):
    """A save every ten steps and the last three of a run kept, over four files whose steps are in no order."""
    out = scratch_path(t.spark, "saves")
    steps = t.table("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"))
    steps.repartition(4).write.parquet(f"{out}/in")
    events = save_events(J.stream_files(t.spark, f"{out}/in", steps.schema, max_files=1), every=10, keep=3)
    J.run_available(events, f"{out}/rows", f"{out}/checkpoint")
    return saves_of(t.spark.read.parquet(f"{out}/rows"))
