"""Means against exact fractions, in any order of rows."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spoolworks.functions.means import exact_mean
from spoolworks.operators import metrics as M


def made(seed, n=400):
    rng = random.Random(seed)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 12) for _ in range(n)]
    if seed % 2:  # nearly nothing is left of the sum
        values += [-v for v in values[1:]]
    return values


def bits(rows):
    return {r.g: None if r.m is None else r.m.hex() for r in rows}


def test_any_partitioning_gives_the_same_bits(spark):
    groups = {g: made(g) for g in range(6)}
    rows = [(g, v) for g, values in groups.items() for v in values]
    seen = []
    for seed, parts in ((1, 1), (2, 3), (3, 7)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
        seen.append(bits(df.groupBy("g").agg(exact_mean("v").alias("m")).collect()))
    assert seen[0] == seen[1] == seen[2]
    for g, values in groups.items():
        exact = sum(map(Fraction, values)) / len(values)
        assert abs(Fraction(float.fromhex(seen[0][g])) - exact) <= abs(exact) * Fraction(1, 2**51)


@pytest.mark.parametrize(
    "values,mean",
    [
        ([], None),
        ([None, None], None),
        ([None, 3.0], 3.0),
        ([0.1] * 10, 0.1),
        ([1e16, 1.0, -1e16], 1 / 3),
        ([-1e-20], -1e-20),
        ([-0.5, 0.25], -0.125),
        ([1e300, 1e300], 1e300),
        ([1.0, math.inf], math.inf),
        ([1.0, math.nan], math.nan),
    ],
)
def test_edges(spark, values, mean):
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(exact_mean("v")).first()[0]
    assert got == mean or math.isnan(mean) and math.isnan(got)


def test_run_means_do_not_depend_on_order(spark):
    rows = [("r", i, v) for i, v in enumerate(made(2))]
    got = set()
    for seed, parts in ((1, 1), (2, 4), (3, 9)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "run string, step long, loss double").repartition(parts)
        got.add((M.run_summary(df).first().train_loss.hex(), M.perplexity(df, "loss").first().eval_loss.hex()))
    assert len(got) == 1
    floats = spark.createDataFrame([("r", 1, 2.5), ("r", 2, None)], "run string, step int, loss float")
    assert M.run_summary(floats).select(F.col("train_loss"), "logged").first() == (2.5, 1)
