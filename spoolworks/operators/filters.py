"""Row checks, rejects and metric filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quarantine_bad_rows(df: DataFrame, json_column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed rows and rejects of a JSON text column; nothing is dropped unseen."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn(
        "record",
        F.from_json(json_column, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}),
    )
    rest = [c for c in df.columns if c != json_column]
    broken = F.col("record._corrupt_record").isNotNull() | F.col("record").isNull()
    good = parsed.where(~broken).select(*rest, *[F.col(f"record.{f}").alias(f) for f in schema.names])
    bad = parsed.where(broken).select(*rest, json_column)
    return good, bad


def require_rows(df: DataFrame, what: str = "dataset") -> DataFrame:
    """The same frame, or an error when it is empty; looks for one row only."""
    if df.isEmpty():
        raise ValueError(f"no valid data found in the {what}")
    return df


def require_every(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """The same rows, but running the plan fails at the first row that breaks the rule."""
    passed = F.coalesce(rule, F.lit(False))
    return df.where(F.when(passed, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def metric_name_filter(series: DataFrame, which: str) -> DataFrame:
    """``loss``, ``learning_rate`` or ``all`` (everything but step and epoch)."""
    tag = F.lower("tag")
    tests: dict[str, Column] = {
        "loss": F.contains(tag, F.lit("loss")),
        "learning_rate": F.contains(tag, F.lit("learning")) & F.contains(tag, F.lit("rate")),
        "all": ~F.col("tag").isin("step", "epoch"),
    }
    if which not in tests:
        raise ValueError(f"which must be one of {sorted(tests)}")
    return series.where(tests[which])


def cadence_filter(df: DataFrame, every: int, step: str = "step") -> DataFrame:
    return df.where(F.col(step) % every == 0)
