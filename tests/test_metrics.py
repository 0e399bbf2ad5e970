import math

import pytest
from pyspark.sql import functions as F

from spoolworks.operators import filters as FL
from spoolworks.operators import metrics as M
from spoolworks.operators import registry as U
from spoolworks.operators import steps as S
from spoolworks.plans.metric_data import metric_series
from spoolworks.sources import files as SRC

# Logged losses and stored results of three recorded runs: (name, steps logged, losses, mean loss,
# runtime, rows per step, samples/s, steps/s, warm-up, steps, first and last learning rate).
RUNS = [
    ("three_cards", 2, [2.6389, 2.7848, 2.566, 2.6831, 2.4534, 2.6171, 2.465, 2.3299, 2.3205, 2.2314],
     2.509015703201294, 1596.7364, 12, 0.15, 0.013, 5, 20, [4e-6, 1.2e-5, 2e-5, 1.7333333333333336e-5, 1.4666666666666666e-5, 1.2e-5, 9.333333333333334e-6, 6.666666666666667e-6, 4e-6, 1.3333333333333334e-6]),
    ("one_card", 2, [2.5758, 3.0449, 2.449, 2.384, 3.1338, 2.3368, 2.972, 1.9488, 2.1653, 2.2601],
     2.527050805091858, 136.4872, 4, 0.586, 0.147, 5, 20, [4e-6, 1.2e-5, 2e-5, 1.7333333333333336e-5, 1.4666666666666666e-5, 1.2e-5, 9.333333333333334e-6, 6.666666666666667e-6, 4e-6, 1.3333333333333334e-6]),
    ("quick", 1, [2.3946, 3.2382, 3.3863, 2.9586, 3.1476],
     3.0250670433044435, 89.2659, 3, 0.168, 0.056, 0, 5, [2e-5, 1.6e-5, 1.2e-5, 8e-6, 4e-6]),
]


def log(spark):
    rows = []
    for name, every, losses, _, runtime, per_step, _, _, _, _, rates in RUNS:
        rows += [(name, every * (i + 1), x, lr, None, per_step) for i, (x, lr) in enumerate(zip(losses, rates))]
        rows.append((name, every * len(losses), None, None, runtime, per_step))
    return spark.createDataFrame(rows, "run string, step long, loss double, learning_rate double, train_runtime double, per_step int")


def test_run_summary_equals_stored_results(spark):
    summary = M.run_summary(log(spark), extras=["train_runtime", "per_step"])
    rates = {r.run: r for r in M.run_rates(summary, "train_runtime", F.col("per_step")).collect()}
    for name, every, losses, mean, runtime, _, samples, steps, _, n, _ in RUNS:
        r = rates[name]
        assert math.isclose(r.train_loss, mean, abs_tol=5e-5)
        assert (r.last_loss, r.steps, r.logged, r.train_runtime) == (losses[-1], n, len(losses), runtime)
        assert round(r.train_samples_per_second, 3) == samples and round(r.train_steps_per_second, 3) == steps


def test_rates_of_a_run_without_runtime(spark):
    rates = M.run_rates(spark.createDataFrame([("a", 1, 0.0), ("b", 4, 2.0)], "run string, steps long, s double"), "s", F.lit(3))
    assert sorted(map(tuple, rates.collect())) == [("a", 1, 0.0, None, None), ("b", 4, 2.0, 6.0, 2.0)]


def test_epoch_progress(spark):
    df = spark.createDataFrame([(20, 1, 4, 3, 0.016), (20, 1, 4, 1, 0.005333333333333333), (5, 1, 1, 3, 0.001)], "s long, b int, a int, w int, e double")
    for r in df.collect():
        one = spark.createDataFrame([(r.s,)], "s long").select(S.epoch_progress(F.col("s"), r.b, r.a, r.w, F.lit(15000)).alias("e")).first()
        assert math.isclose(one.e, r.e, rel_tol=1e-12)


@pytest.mark.parametrize("n", [1, 4])
def test_accumulation_flags(spark, n):
    rows = S.assign_steps(spark.range(5).withColumnRenamed("id", "rank"), accumulation=n).orderBy("rank").collect()
    assert [r.should_step for r in rows] == [i % n == 0 for i in range(1, 6)]
    assert [r.should_zero_grad for r in rows] == [i % n == 1 for i in range(1, 6)]
    assert {r.scale for r in rows} == {1.0 / n}


def test_param_summary(spark):
    params = spark.createDataFrame([("a.weight", 5000, True), ("a.bias", 50, True), ("b.weight", 500, True), ("b.bias", 10, True)], "name string, numel long, trainable boolean")
    r = M.param_summary(params).first()
    assert (r.total_parameters, r.trainable_parameters, r.trainable_percentage) == (5560, 5560, 100.0)
    assert r.total_size_gb == 5560 * 4 / 1024**3
    empty = M.param_summary(params.where("false")).first()
    assert (empty.total_parameters, empty.trainable_percentage) == (0, 0.0)


def brute_rollup(params, modules, on_segment):
    out = {}
    for module, device in modules:
        out.setdefault(device, 0)
        for name, numel in params:
            if name.startswith(module) and (not on_segment or module == "" or name[len(module):][:1] in ("", ".")):
                out[device] += numel
    return out


@pytest.mark.parametrize("on_segment", [False, True])
def test_prefix_rollup_equals_theta_join(spark, on_segment):
    params = [("layers.1.w", 3), ("layers.10.w", 5), ("layers.10", 7), ("head", 11), ("layers", 13)]
    modules = [("layers.1", 0), ("layers.10", 1), ("head", 0), ("missing", 2), ("", 3), ("layers", 1)]
    p = spark.createDataFrame(params, "name string, numel long")
    m = spark.createDataFrame(modules, "module string, device int")
    got = {r.device: r.numel for r in M.prefix_rollup(p, m, on_segment).collect()}
    assert got == brute_rollup(params, modules, on_segment)


def test_perplexity_forms(spark):
    flat = spark.createDataFrame([(1.0,), (3.0,)], "p double")
    deep = spark.createDataFrame([([1.0, 9.0],), ([3.0, 9.0],)], "p array<double>")
    for df in (flat, deep):
        r = M.perplexity(df, "p").first()
        assert (r.eval_loss, r.eval_perplexity) == (2.0, math.exp(2.0))
    assert M.metric_function("classification") is None


def test_unpivot_and_filters(spark):
    wide = spark.createDataFrame([(1, 0.1, 2.0, 1e-5, None), (2, 0.2, 1.0, None, 5.0)], "step long, epoch double, train_loss double, learning_rate double, Eval_Loss double")
    everything = sorted(map(tuple, M.unpivot_metrics(wide).collect()), key=str)
    assert everything == [(1, "learning_rate", 1e-5), (1, "train_loss", 2.0), (2, "Eval_Loss", 5.0), (2, "train_loss", 1.0)]
    loss = metric_series(table=wide, which="loss")
    assert {r.tag for r in loss.collect()} == {"train_loss", "Eval_Loss"}
    assert {r.tag for r in metric_series(table=wide, which="learning_rate").collect()} == {"learning_rate"}
    no_step = wide.drop("step").withColumnRenamed("epoch", "at")
    assert sorted(r.step for r in M.unpivot_metrics(no_step, order_key="at").collect()) == [0, 0, 1, 1]
    assert FL.cadence_filter(wide, 2).count() == 1
    with pytest.raises(ValueError):
        FL.metric_name_filter(loss, "other")
    with pytest.raises(ValueError):
        metric_series()


def test_check_report(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (-1, "b")], "id long, t string")
    report = M.check_report(df, {"positive": F.col("id") > 0, "text": F.length("t") > 0, "fine": F.lit(True)})
    assert {r.check: (r.failed_rows, r.passed) for r in report.collect()} == {"positive": (1, False), "text": (1, False), "fine": (0, True)}
    assert tuple(M.report_verdict(report).first()) == (1, 2, False)


def test_gpu_aggregates(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01", 0, 24.0, 20.125, 12.0), ("2024-01-01 00:30:00", 1, 24.0, 1.0, 6.0)], "t string, gpu int, total_gb double, reserved_gb double, allocated_gb double").withColumn("ts", F.col("t").cast("timestamp"))
    r = M.gpu_memory(df, ["gpu"]).where("gpu = 0").first()
    assert (r.total, r.reserved, r.allocated, r.free, r.utilization) == (24.0, 20.13, 12.0, 3.88, 50.0)
    wide = M.gpu_wide(df, [0, 1, 2]).first()
    assert (wide.gpu0_mem, wide.gpu1_util, wide.gpu2_mem) == (12.0, 25.0, None)
    assert tuple(M.distinct_devices(df, "gpu").first()) == (2, "0,1")


def test_registry(spark):
    df = spark.createDataFrame([("t", "c", "p")], "text string, caption string, image string")
    assert U.formatter("unknown")(df).columns == ["messages"]
    U.register_formatter("mine", lambda d: d.select("caption"))
    assert df.transform(U.formatter("mine")).columns == ["caption"]
    doubled = U.map_batches(spark.range(10), lambda b: b.assign(id=b["id"] * 2), "id long", workers=3)
    assert sorted(r.id for r in doubled.collect()) == list(range(0, 20, 2))
    assert U.map_rows(df, n=F.length("text")).columns == ["n"]
    assert U.map_rows(df, False, n=F.length("text")).columns == ["text", "caption", "image", "n"]
    assert U.filter_rows(spark.range(5), F.col("id") > 2).count() == 2


def test_scan_run_logs_keeps_the_newest_state(spark):
    schema = "run string, path string, log_history array<struct<step:long,epoch:double,loss:double,lr:double>>"
    states = spark.createDataFrame([
        ("r", "checkpoint-10", [(2, 0.1, 9.0, None)]),
        ("r", "checkpoint-20", [(2, 0.1, 1.0, None), (4, 0.2, 0.5, 1e-5)]),
    ], schema)
    rows = sorted(map(tuple, SRC.scan_run_logs(states, path="path").collect()))
    assert rows == [("r", "loss", 2, 1.0), ("r", "loss", 4, 0.5), ("r", "lr", 4, 1e-5)]
    assert SRC.scan_run_logs(states).count() == 4
