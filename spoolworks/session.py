"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: An Arrow batch of Spark has 10,000 rows, whatever their size, and an executor holds it several times over for each task.
BATCH_BYTES = 8 << 20


def build_session(app_name: str = "spoolworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; what the cluster or the caller has set stays."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in DEFAULTS.items():
        if key not in conf and not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Ends the session's Arrow batches at ``BATCH_BYTES`` or the row that passes them; a limit that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, which every executor can reach.

    A cluster without the setting is an error. A local master without it, as in tests, gets one
    temporary folder, and the session's setting then names it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spoolworks-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten there."""
    return f"{scratch_root(spark)}/spoolworks/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """The rows dealt to so many tasks; without a number they stay where they are."""
    return df.repartition(partitions) if partitions else df


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
