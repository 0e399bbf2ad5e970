"""The record shapes the operators work on, derived from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import exact_rank, with_range_segment
from .turns import question_answer_pairs, turns_to_messages


class Tables:
    """The given tables of one folder and the views over them; every view is lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        # times are stored without a zone and are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tasks_for(self, name: str) -> int | None:
        """Tasks for costly work on a table of fewer files than the session has cores; null leaves the readers' splits."""
        cores = self.spark.sparkContext.defaultParallelism
        return cores if len(self.table(name).inputFiles()) < cores else None

    @cached_property
    def conversations(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def instruction(self) -> DataFrame:
        """Question and answer pairs: conv_id, turn, instruction, input, output."""
        return question_answer_pairs(self.conversations)

    @cached_property
    def messages(self) -> DataFrame:
        return turns_to_messages(self.conversations)

    @cached_property
    def captions(self) -> DataFrame:
        """One image record per document whose lines are the captions."""
        return self.documents.select(
            "doc_id",
            F.concat(F.lit("images/doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"),
            F.split("text", "\n").alias("captions"),
            "lang",
        )

    @cached_property
    def inventory(self) -> DataFrame:
        """Image files that exist, and whether they decode."""
        return self.table("labels").select(
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file_name"),
            (F.col("quality") == 1).alias("decodes"),
        )

    @cached_property
    def train_log(self) -> DataFrame:
        """One log row per event, steps counted per run in time order."""
        rows = self.events.select("user_id", "ts", "event_id", "value")
        # pieces of time of about equal rows cut a run that holds much of the log
        ranked = exact_rank(
            with_range_segment(rows, "ts", name="piece"), [F.col("ts"), F.col("event_id")], F.col("piece"), ("user_id",), "step"
        )
        return ranked.select(
            F.col("user_id").alias("run"),
            (F.col("step") + 1).alias("step"),
            (F.col("value") / 100).alias("loss"),
            (F.lit(2e-5) * (1 - F.col("value") / 1000)).alias("learning_rate"),
        )

    @cached_property
    def gpu(self) -> DataFrame:
        return gpu_samples(self.events)

    @cached_property
    def params(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.col("p_partkey").cast("string")).alias("name"),
            F.col("p_size").cast("long").alias("numel"),
            (F.col("p_type") == "PROMO").alias("trainable"),
        )

    @cached_property
    def modules(self) -> DataFrame:
        prefix = F.substring("p_name", 1, 3)
        return (
            self.table("part").groupBy(prefix.alias("module"))
            .agg((F.count(F.lit(1)) % 3).alias("device"))
        )


def gpu_samples(events: DataFrame) -> DataFrame:
    """Device samples from events; works on a stream of events too."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 3).alias("gpu"),
        F.lit(24.0).alias("total_gb"),
        (F.col("value") / 30).alias("reserved_gb"),
        (F.col("value") / 40).alias("allocated_gb"),
    )


# The same views for the comparison engine.
V_INSTRUCTION = """v_instruction AS (
  SELECT conv_id, turn, instruction, input, output FROM (
    SELECT conv_id, turn, role, text AS instruction,
           LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
           LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS output,
           COALESCE(MAX(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id), '') AS input
    FROM conversations) q
  WHERE role = 'user' AND next_role = 'assistant')"""

V_CAPTIONS = """v_captions AS (
  SELECT doc_id, CONCAT('images/doc_', CAST(doc_id AS VARCHAR), '.jpg') AS image,
         string_split(text, chr(10)) AS captions, lang
  FROM documents)"""

V_INVENTORY = """v_inventory AS (
  SELECT CONCAT('doc_', CAST(doc_id AS VARCHAR), '.jpg') AS file_name, quality = 1 AS decodes FROM labels)"""

V_TRAIN_LOG = """v_train_log AS (
  SELECT user_id AS run, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         value / 100 AS loss, CAST(2e-5 AS DOUBLE) * (1 - value / 1000) AS learning_rate
  FROM events)"""

V_GPU = """v_gpu AS (
  SELECT ts, user_id % 3 AS gpu, CAST(24 AS DOUBLE) AS total_gb,
         value / 30 AS reserved_gb, value / 40 AS allocated_gb
  FROM events)"""

V_PARAMS = """v_params AS (
  SELECT CONCAT(REPLACE(p_name, ' ', '.'), '.', CAST(p_partkey AS VARCHAR)) AS name,
         CAST(p_size AS BIGINT) AS numel, p_type = 'PROMO' AS trainable
  FROM part)"""

V_MODULES = """v_modules AS (
  SELECT SUBSTR(p_name, 1, 3) AS module, COUNT(*) % 3 AS device FROM part GROUP BY SUBSTR(p_name, 1, 3))"""
