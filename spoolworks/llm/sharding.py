"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .common import whole

SHARDS = 16
PART_ROWS = 100_000


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (null: none) plus one. The order is by id, null first; rows of one
    id follow each other in any order. The sizes are summed per range partition, the few totals are
    summed up, and each row adds its own place within its partition; a row belongs to the
    shard in which its middle byte lies. So shards are contiguous in the order, and a shard's bytes
    differ from the mean by less than the largest size. The range partitions are written once, since
    the boundaries are sampled and must not move when an executor is lost. An id that many rows share
    is split too, because the written row number is part of the order. Only sizes and ids move,
    never texts. Equal texts are told by ``text_crc32`` and ``size`` and are not moved together: a group of copies
    lies wherever its ids do, so that a group with a third of all rows leaves the shards equal. An empty table
    gives an empty table.
    """
    sized = write_through(
        docs.select(
            F.col(id_col),
            (F.octet_length(whole(text_col)) + 1).cast("long").alias("size"),
            F.crc32(whole(text_col)).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    order = [F.col(id_col).asc_nulls_first(), F.col("row")]
    parts = max(1, math.ceil(sized.count() / part_rows))
    ranged = write_through(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")

    # one row for each range partition
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(upto), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(upto), F.lit(0)).alias("rows_before"),
    )
    total = ranged.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]

    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = write_through(
        ranged.join(offsets, "part").select(
            id_col,
            "size",
            "text_crc32",
            (F.col("bytes_before") + F.sum("size").over(running) - F.col("size")).alias("start"),
            (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
        ),
        "places",
    )
    shard = F.least(F.lit(shards - 1), F.expr(f"((2 * start + size) * {shards}) div {2 * total}")).cast("int")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
