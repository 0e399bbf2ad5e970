"""Orders of epochs as computed permutations."""

import pytest
from pyspark.sql import functions as F

from spoolworks.operators import epochs as E


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 16, 17, 1000, 4099])
def test_every_epoch_is_a_permutation(spark, rows):
    positions = spark.range(rows).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(9))).alias("epoch"))
    ranked = positions.withColumn("rank", E.epoch_rank(F.col("id"), rows, F.col("epoch")))
    back = ranked.withColumn("back", E.epoch_position(F.col("rank"), rows, F.col("epoch"))).collect()
    assert all(r.id == r.back for r in back)
    orders = {}
    for epoch in (0, 1, 9):
        orders[epoch] = [r.rank for r in sorted(back, key=lambda r: r.id) if r.epoch == epoch]
        assert sorted(orders[epoch]) == list(range(rows))
    if rows >= 1000:
        assert orders[0] != orders[1] != orders[9]
        # halves of the table spread over halves of the order
        low = sum(r < rows // 2 for r in orders[1][: rows // 2])
        assert abs(low - rows / 4) < 5 * (rows / 16) ** 0.5


def test_resume_is_the_tail_and_nothing_moves(spark):
    df = spark.range(500).select(F.col("id").alias("p"), (F.col("id") * 2).alias("v"), F.lit("own").alias("rank"))
    whole = {(r.epoch, r.rank): r.v for r in E.reshuffled(df, "p", 500, 3).collect()}
    assert len(whole) == 1500
    tail = E.reshuffled(df, "p", 500, 3, resume=(1, 123))
    assert {(r.epoch, r.rank): r.v for r in tail.collect()} == {k: v for k, v in whole.items() if k >= (1, 123)}
    assert "Exchange" not in tail._jdf.queryExecution().executedPlan().toString()
    assert E.reshuffled(df, "p", 500, 3, resume=(3, 0)).count() == 0
    other = {(r.epoch, r.rank): r.v for r in E.reshuffled(df, "p", 500, 3, seed=7).collect()}
    assert other != whole and sorted(other.values()) == sorted(whole.values())


def test_a_position_column_may_be_named_rank_or_epoch(spark):
    for name in ("rank", "epoch"):
        got = E.reshuffled(spark.range(40).withColumnRenamed("id", name), name, 40, 2)
        assert sorted((r.epoch, r["rank"]) for r in got.collect()) == [(e, i) for e in (0, 1) for i in range(40)]


def test_edges(spark):
    assert E.reshuffled(spark.range(0), "id", 0, 2).count() == 0
    null = spark.createDataFrame([(None, 1), (3, None)], "p long, e int").select(E.epoch_rank(F.col("p"), 5, F.col("e")).alias("x"))
    assert [r.x for r in null.collect()] == [None, None]
    with pytest.raises(Exception, match="positions go from 0"):
        spark.range(6).select(E.epoch_rank(F.col("id"), 5, F.lit(0))).collect()
