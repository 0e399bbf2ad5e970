"""Events of a stream as a table."""

import pytest
from pyspark.sql import functions as F

from spoolworks.streaming.jobs import stream_files
from spoolworks.streaming.progress import read_progress, run_observed

def metrics():
    return {"n": F.count(F.lit(1)), "total": F.sum("v"), "largest": F.max("v")}


def put(spark, folder, a, b):
    spark.range(a, b, 1, 1).select(F.col("id").alias("v")).write.mode("append").parquet(folder)


def test_a_row_for_each_batch_and_restart(spark, tmp_path):
    source, out, check, log = (str(tmp_path / n) for n in ("in", "out", "check", "log"))
    for a in (0, 10, 30):
        put(spark, source, a, a + 10)
    stream = lambda: stream_files(spark, source, spark.read.parquet(source).schema, max_files=1)
    run_observed(stream(), out, check, log, metrics())
    events = read_progress(spark, log)
    batches = events.where("event = 'progress'").orderBy("batch").collect()
    assert [r.batch for r in batches] == [0, 1, 2]
    assert sorted(r.metrics["largest"] for r in batches) == [9.0, 19.0, 39.0]
    assert sum(r.metrics["n"] for r in batches) == sum(r.input_rows for r in batches) == spark.read.parquet(out).count() == 30
    # the stream goes on behind its checkpoint, under the same query
    put(spark, source, 100, 105)
    run_observed(stream(), out, check, log, metrics())
    events = read_progress(spark, log)
    assert events.select("query").distinct().count() == 1
    assert [r.metrics["n"] for r in events.where("batch = 3").collect()] == [5.0]
    assert {r.event: r.n for r in events.groupBy("event").agg(F.count(F.lit(1)).alias("n")).collect()} == {"started": 2, "progress": 4, "ended": 2}


def test_a_failed_stream_has_its_end_logged(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    put(spark, source, 0, 5)
    bad = stream_files(spark, source, spark.read.parquet(source).schema).where(F.raise_error(F.lit("no good")).cast("boolean"))
    with pytest.raises(Exception, match="no good"):
        run_observed(bad, str(tmp_path / "out"), str(tmp_path / "check"), log, metrics())
    ended = read_progress(spark, log).where("event = 'ended'").collect()
    assert len(ended) == 1 and ended[0].error
