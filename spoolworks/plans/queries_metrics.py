"""Queries over run logs, parameter manifests and device samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import round_half_up
from ..operators import filters as FL
from ..operators import metrics as M
from .catalog import query
from .standins import V_GPU, V_MODULES, V_PARAMS, V_TRAIN_LOG

LONG = """v_long AS (
  SELECT run, step, 'loss' AS tag, loss AS value FROM v_train_log
  UNION ALL SELECT run, step, 'learning_rate', learning_rate FROM v_train_log)"""


# Means of short decimals often lie exactly on a rounding boundary, where the order of
# summing would decide. Both engines round at a boundary moved off those values.
NUDGE = 1e-3


def r(x: str, places: int = 6) -> str:
    return f"floor(({x}) * 1e{places} + {0.5 + NUDGE}) / 1e{places}"


def settled(value: Column, places: int = 6) -> Column:
    return round_half_up(value + NUDGE / 10**places, places)


@query(
    "perplexity",
    f"SELECT run, {r('avg(loss)')} AS eval_loss, {r('exp(avg(loss))')} AS eval_perplexity FROM v_train_log GROUP BY run",
    (V_TRAIN_LOG,),
)
def _(t):
    rows = t.train_log.withColumn("predictions", F.array("loss", "learning_rate"))
    metric = M.metric_function("generation")(rows, "predictions", ["run"])
    return metric.select("run", settled(F.col("eval_loss")).alias("eval_loss"), settled(F.col("eval_perplexity")).alias("eval_perplexity"))


@query(
    "run_summary",
    f"""SELECT run, {r('avg(loss)')} AS train_loss, arg_max(loss, step) AS last_loss, max(step) AS steps, count(loss) AS logged
        FROM v_train_log GROUP BY run""",
    (V_TRAIN_LOG,),
)
def _(t):
    return M.run_summary(t.train_log).withColumn("train_loss", settled(F.col("train_loss")))


@query(
    "run_rates",
    f"""SELECT user_id AS run, count(*) AS steps, {r("count(*) * 12 / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0) * 1e6")} AS train_samples_per_second,
               {r("count(*) / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0) * 1e6")} AS train_steps_per_second
        FROM events GROUP BY user_id""",
)
def _(t):
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    summary = t.events.groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("steps"), seconds.alias("runtime"))
    rates = M.run_rates(summary, "runtime", F.lit(12))
    return rates.select(
        "run", "steps",
        *[settled(F.col(c)).alias(c) for c in ("train_samples_per_second", "train_steps_per_second")],
    )


@query(
    "param_summary",
    f"""SELECT CAST(sum(numel) AS BIGINT) AS total_parameters,
          CAST(coalesce(sum(CASE WHEN trainable THEN numel END), 0) AS BIGINT) AS trainable_parameters,
          {r('sum(numel) * 4 / 1073741824::DOUBLE', 9)} AS total_size_gb,
          {r('coalesce(sum(CASE WHEN trainable THEN numel END), 0) * 4 / 1073741824::DOUBLE', 9)} AS trainable_size_gb,
          {r('coalesce(sum(CASE WHEN trainable THEN numel END), 0) / sum(numel)::DOUBLE * 100')} AS trainable_percentage
        FROM v_params""",
    (V_PARAMS,),
)
def _(t):
    s = M.param_summary(t.params)
    return s.withColumns({
        "total_size_gb": settled(F.col("total_size_gb"), 9),
        "trainable_size_gb": settled(F.col("trainable_size_gb"), 9),
        "trainable_percentage": settled(F.col("trainable_percentage")),
    })


def r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


@query(
    "gpu_memory",
    f"""SELECT date_trunc('day', ts)::TIMESTAMP AS day, gpu, count(*) AS samples, {r2('max(total_gb)')} AS total,
          {r2('max(reserved_gb)')} AS reserved, {r2('max(allocated_gb)')} AS allocated,
          {r2('min(total_gb - reserved_gb)')} AS free, {r2('max(allocated_gb / total_gb * 100)')} AS utilization
        FROM v_gpu GROUP BY 1, 2""",
    (V_GPU,),
)
def _(t):
    daily = t.gpu.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return M.gpu_memory(daily, ["day", "gpu"])


@query("unpivot_metrics", "SELECT run, step, tag, value FROM v_long", (V_TRAIN_LOG, LONG))
def _(t):
    return M.unpivot_metrics(t.train_log, ["run"])


@query(
    "unpivot_metrics_by_position",
    """SELECT row_number() OVER (ORDER BY event_id) - 1 AS step, 'value' AS tag, value FROM events""",
)
def _(t):
    return M.unpivot_metrics(t.table("events").select("event_id", "value"), order_key="event_id")


@query(
    "check_report",
    """SELECT 'has_text' AS "check", count(*) FILTER (WHERE NOT (length(text) > 0)) AS failed_rows,
              count(*) FILTER (WHERE NOT (length(text) > 0)) = 0 AS passed FROM documents
       UNION ALL SELECT 'long_enough', count(*) FILTER (WHERE NOT (n_chars >= 50)), count(*) FILTER (WHERE NOT (n_chars >= 50)) = 0 FROM documents
       UNION ALL SELECT 'length_matches', count(*) FILTER (WHERE n_chars <> length(text)), count(*) FILTER (WHERE n_chars <> length(text)) = 0 FROM documents""",
)
def _(t):
    return M.check_report(t.documents, {
        "has_text": F.length("text") > 0,
        "long_enough": F.col("n_chars") >= 50,
        "length_matches": F.col("n_chars") == F.length("text"),
    })


@query(
    "report_verdict",
    """SELECT count(*) FILTER (WHERE f = 0) AS passed, count(*) FILTER (WHERE f > 0) AS failed, bool_and(f = 0) AS all_passed FROM (
         SELECT count(*) FILTER (WHERE quality NOT IN (0, 1)) AS f FROM labels
         UNION ALL SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) FROM labels
         UNION ALL SELECT count(*) FILTER (WHERE doc_id < 0) FROM labels) q""",
)
def _(t):
    report = M.check_report(t.table("labels"), {
        "binary_quality": F.col("quality").isin(0, 1),
        "good_is_clean": ~((F.col("quality") == 1) & (F.col("toxic") == 1)),
        "id_not_negative": F.col("doc_id") >= 0,
    })
    return M.report_verdict(report)


@query(
    "distinct_devices",
    """SELECT day, count(DISTINCT gpu) AS n_devices, string_agg(DISTINCT CAST(gpu AS VARCHAR), ',' ORDER BY CAST(gpu AS VARCHAR)) AS devices
       FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, gpu FROM v_gpu) q GROUP BY day""",
    (V_GPU,),
)
def _(t):
    return M.distinct_devices(t.gpu.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz")), "gpu", ["day"])


@query(
    "gpu_wide",
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS tick, "
    + ", ".join(
        f"{r2(f'max(allocated_gb) FILTER (WHERE gpu = {g})')} AS gpu{g}_mem, "
        f"{r2(f'max(allocated_gb / total_gb * 100) FILTER (WHERE gpu = {g})')} AS gpu{g}_util"
        for g in range(3)
    )
    + " FROM v_gpu GROUP BY 1",
    (V_GPU,),
)
def _(t):
    wide = M.gpu_wide(t.gpu, [0, 1, 2])
    return wide.withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query(
    "prefix_rollup",
    f"""SELECT device, CAST(coalesce(sum(numel), 0) AS BIGINT) AS numel,
          {r('coalesce(sum(numel), 0) / (SELECT sum(numel) FROM v_params)::DOUBLE * 100')} AS percent
        FROM v_modules LEFT JOIN v_params ON starts_with(name, module) GROUP BY device""",
    (V_PARAMS, V_MODULES),
)
def _(t):
    return M.prefix_rollup(t.params, t.modules).withColumn("percent", settled(F.col("percent")))


@query(
    "prefix_rollup_on_segment",
    f"""SELECT device, CAST(coalesce(sum(numel), 0) AS BIGINT) AS numel,
          {r('coalesce(sum(numel), 0) / (SELECT sum(numel) FROM v_params)::DOUBLE * 100')} AS percent
        FROM v_modules LEFT JOIN v_params ON starts_with(name, module)
             AND (length(name) = length(module) OR substr(name, length(module) + 1, 1) = '.') GROUP BY device""",
    (V_PARAMS, V_MODULES),
)
def _(t):
    rolled = M.prefix_rollup(t.params, t.modules, on_segment=True)
    return rolled.withColumn("percent", settled(F.col("percent")))


@query(
    "metric_name_filter",
    "SELECT run, step, tag, value FROM v_long WHERE lower(tag) LIKE '%learning%' AND lower(tag) LIKE '%rate%'",
    (V_TRAIN_LOG, LONG),
)
def _(t):
    return FL.metric_name_filter(M.unpivot_metrics(t.train_log, ["run"]), "learning_rate")


@query("cadence_filter", "SELECT run, step, loss FROM v_train_log WHERE step % 10 = 0", (V_TRAIN_LOG,))
def _(t):
    return FL.cadence_filter(t.train_log.select("run", "step", "loss"), 10)


@query(
    "clean_tag",
    "SELECT run, step, concat('train_', tag) AS tag, value FROM v_long",
    (V_TRAIN_LOG, LONG),
)
def _(t):
    series = M.unpivot_metrics(t.train_log, ["run"]).withColumn("tag", F.concat(F.lit("train/"), "tag"))
    return series.withColumn("tag", X.clean_tag(F.col("tag")))


@query(
    "format_log_line",
    """SELECT run, step, concat('run: ', run, ' - loss: ', printf('%.4f', loss)) AS line,
              concat('loss: ', printf('%.4f', loss)) AS map_line FROM v_train_log""",
    (V_TRAIN_LOG,),
)
def _(t):
    log = t.train_log
    return log.select(
        "run", "step", X.log_line(log, ["run", "loss"]).alias("line"),
        X.log_line_of_map(F.create_map(F.lit("loss"), F.col("loss"))).alias("map_line"),
    )
