"""Aggregates over run logs, parameter manifests and device samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.means import exact_mean
from ..functions.text import round_half_up
from .ranking import input_rank


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split, and the total under a null split."""
    return df.rollup(split).agg(F.count(F.lit(1)).alias("rows"))


def perplexity(df: DataFrame, predictions: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean prediction and its exponential, the same in any order of rows; the first entry counts when predictions are arrays."""
    kind = df.schema[predictions].dataType.typeName()
    value = F.get(predictions, F.lit(0)) if kind == "array" else F.col(predictions)
    loss = exact_mean(value)
    return df.groupBy(*by).agg(loss.alias("eval_loss"), F.exp(loss).alias("eval_perplexity"))


def run_summary(log: DataFrame, run: str = "run", extras: Sequence[str] = ()) -> DataFrame:
    """Mean (the same in any order of rows) and last loss and steps of each run; end-of-run figures such as the runtime when logged."""
    figures = [F.max(c).alias(c) for c in extras]
    has_loss = F.col("loss").isNotNull()
    return log.groupBy(run).agg(
        exact_mean("loss").alias("train_loss"),
        F.max_by(F.when(has_loss, F.col("loss")), F.when(has_loss, F.col("step"))).alias("last_loss"),
        F.max("step").alias("steps"),
        F.count("loss").alias("logged"),
        *figures,
    )


def run_rates(summary: DataFrame, runtime: str, samples_per_step: Column) -> DataFrame:
    """Samples and steps per second from the runtime of each run; null for a run without runtime, such as one of one step."""
    return summary.withColumns({
        "train_samples_per_second": F.try_divide(F.col("steps") * samples_per_step, F.col(runtime)),
        "train_steps_per_second": F.try_divide(F.col("steps"), F.col(runtime)),
    })


def param_summary(params: DataFrame) -> DataFrame:
    """Counts and float32 sizes of all and of trainable parameters."""
    gib = float(1024**3)
    sums = params.agg(
        F.coalesce(F.sum("numel"), F.lit(0)).alias("total_parameters"),
        F.coalesce(F.sum(F.when(F.col("trainable"), F.col("numel"))), F.lit(0)).alias("trainable_parameters"),
    )
    total, trainable = F.col("total_parameters"), F.col("trainable_parameters")
    return sums.withColumns({
        "total_size_gb": total * 4 / F.lit(gib),
        "trainable_size_gb": trainable * 4 / F.lit(gib),
        "trainable_percentage": F.when(total > 0, trainable / total * 100).otherwise(F.lit(0.0)),
    })


def gpu_memory(samples: DataFrame, by: list[str]) -> DataFrame:
    """Memory of each device over a group of samples, two places, free being total less reserved."""
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        round_half_up(F.max("total_gb")).alias("total"),
        round_half_up(F.max("reserved_gb")).alias("reserved"),
        round_half_up(F.max("allocated_gb")).alias("allocated"),
        round_half_up(F.min(F.col("total_gb") - F.col("reserved_gb"))).alias("free"),
        round_half_up(F.max(F.col("allocated_gb") / F.col("total_gb") * 100)).alias("utilization"),
    )


def unpivot_metrics(df: DataFrame, ids: Sequence[str] = (), step: str = "step", order_key: str | None = None) -> DataFrame:
    """Wide metric table to ``tag, step, value``; without a step column the row position is the step."""
    if step not in df.columns:
        if order_key is None:
            raise ValueError("a table without steps needs an order_key")
        df = input_rank(df, order_key, name=step)
    metrics = [c for c in df.columns if c not in (*ids, step, "epoch", order_key)]
    wide = df.select(*ids, step, *[F.col(c).cast("double").alias(c) for c in metrics])
    return wide.unpivot([*ids, step], metrics, "tag", "value").where(F.col("value").isNotNull())


def check_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Failed rows of every named rule, all in one aggregate; a null outcome is a failure."""
    failed = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    report = failed.unpivot([], list(rules), "check", "failed_rows")
    return report.withColumn("passed", F.col("failed_rows") == 0)


def report_verdict(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"),
    )


def distinct_devices(df: DataFrame, device: str = "device", by: Sequence[str] = ()) -> DataFrame:
    """Number and sorted list of devices used; a device set is small by nature."""
    return df.groupBy(*by).agg(
        F.count_distinct(device).alias("n_devices"),
        F.array_join(F.array_sort(F.collect_set(F.col(device).cast("string"))), ",").alias("devices"),
    )


def gpu_wide(samples: DataFrame, devices: list[int], every: str = "1 hour") -> DataFrame:
    """One row per tick with memory and utilisation of every device side by side."""
    used = F.max("allocated_gb")
    return (
        samples.groupBy(F.window("ts", every).alias("w"))
        .pivot("gpu", devices)
        .agg(
            round_half_up(used).alias("mem"),
            round_half_up(F.max(F.col("allocated_gb") / F.col("total_gb") * 100)).alias("util"),
        )
        .select(F.col("w.start").alias("tick"), *[F.col(f"{d}_{m}").alias(f"gpu{d}_{m}") for d in devices for m in ("mem", "util")])
    )


def prefix_rollup(params: DataFrame, modules: DataFrame, on_segment: bool = False) -> DataFrame:
    """Elements per device, each parameter counted under every module whose name is its prefix.

    The theta join becomes an equi-join: a name is cut at the lengths that module names
    have, sums are combined per prefix before any shuffle, and only then joined. With
    ``on_segment`` a prefix must end at a dot or at the end of the name.
    """
    lengths = (
        modules.select(F.length("module").alias("n")).distinct().agg(F.array_sort(F.collect_set("n"))).scalar()
    )
    fits = F.filter(
        F.col("__lengths"),
        lambda n: (n <= F.length("name"))
        & (
            F.lit(True) if not on_segment
            else (n == F.length("name")) | (F.substr(F.col("name"), n + 1, F.lit(1)) == ".") | (n == 0)
        ),
    )
    per_prefix = (
        params.select("name", F.col("numel").cast("long").alias("numel"))
        .withColumn("__lengths", lengths)
        .select("numel", F.explode(F.transform(fits, lambda n: F.substr(F.col("name"), F.lit(1), n))).alias("module"))
        .groupBy("module")
        .agg(F.sum("numel").alias("numel"))
    )
    total = params.select(F.sum(F.col("numel").cast("long"))).scalar()
    return (
        modules.join(per_prefix, "module", "left")
        .groupBy("device")
        .agg(F.coalesce(F.sum("numel"), F.lit(0)).alias("numel"))
        .withColumn("percent", F.col("numel") / total * 100)
    )


def running_mean(log: DataFrame, run: str = "run") -> DataFrame:
    """Mean loss and number of log rows so far; the same aggregate in batch and stream."""
    return log.groupBy(run).agg(F.avg("loss").alias("mean_loss"), F.count("loss").alias("logged"))


METRIC_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {"generation": perplexity}


def metric_function(task: str = "generation") -> Callable[..., DataFrame] | None:
    """Metric aggregate of a task, none when the task has no metric."""
    return METRIC_FUNCTIONS.get(task)
