import datetime as dt

from pyspark.sql import functions as F

from spoolworks.plans.standins import gpu_samples
from spoolworks.streaming import jobs as J

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        stream = J.stream_files(spark, folder, spark.read.parquet(folder).schema)
        J.run_available(J.gpu_windows(gpu_samples(stream)), out, mark)
        return {(r.start.hour, r.gpu): r.samples for r in spark.read.parquet(out).collect()}

    write(spark, folder, [(1, at(5), 0, "x", 1.0, ""), (2, at(65), 0, "x", 3.0, ""), (3, at(66), 1, "x", 3.0, "")])
    # nothing is older than the watermark yet, at 56 minutes
    assert run() == {}
    write(spark, folder, [(4, at(90), 0, "x", 5.0, "")])
    assert run() == {(0, 0): 1}
    # too late for the closed hour, in time for the open one
    write(spark, folder, [(5, at(6), 0, "x", 9.0, ""), (6, at(200), 0, "x", 1.0, ""), (7, at(95), 0, "x", 1.0, "")])
    run()
    write(spark, folder, [(8, at(500), 0, "x", 1.0, "")])
    assert run() == {(0, 0): 1, (1, 0): 3, (1, 1): 1, (3, 0): 1}


def test_running_means_survive_restarts(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        stream = J.stream_files(spark, folder, spark.read.parquet(folder).schema)
        log = stream.select(F.col("user_id").alias("run"), F.col("value").alias("loss"))
        J.run_running_means(log, out, mark)
        return {r.run: (r.mean_loss, r.logged) for r in J.latest_means(spark, out).collect()}

    write(spark, folder, [(1, at(0), 0, "x", 1.0, ""), (2, at(1), 1, "x", 4.0, "")])
    assert run() == {0: (1.0, 1), 1: (4.0, 1)}
    write(spark, folder, [(3, at(2), 0, "x", 3.0, "")])
    assert run() == {0: (2.0, 2), 1: (4.0, 1)}
    assert run() == {0: (2.0, 2), 1: (4.0, 1)}


def test_batch_twin(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [(1, at(5), 0, "x", 40.0, ""), (2, at(6), 0, "x", 80.0, "")])
    r = J.gpu_windows(gpu_samples(spark.read.parquet(folder))).first()
    assert (r.mean_gb, r.peak_gb, r.samples) == (1.5, 2.0, 2)
    lines = J.metric_lines(spark.createDataFrame([(2, 0.5)], "step long, loss double"), ["loss"])
    assert lines.first().line == "Step 2: loss: 0.5000"
