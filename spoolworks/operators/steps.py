"""Micro-batches, optimiser steps and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_steps(
    df: DataFrame, rank: str = "rank", batch_size: int = 1, accumulation: int = 1, world: int = 1
) -> DataFrame:
    """Micro-batch and optimiser step of each ranked row, with the accumulation flags.

    ``should_zero_grad`` tests a remainder of one, so it is never true for an accumulation of 1.
    """
    return (
        df.withColumn("micro", F.floor(F.col(rank) / (batch_size * world)))
        .withColumns({
            "step": F.floor(F.col("micro") / accumulation),
            "should_step": (F.col("micro") + 1) % accumulation == 0,
            "should_zero_grad": (F.col("micro") + 1) % accumulation == 1,
            "scale": F.lit(1.0 / accumulation),
        })
    )


def epoch_progress(step: Column, batch_size: int, accumulation: int, world: int, rows: Column) -> Column:
    """Fraction of an epoch seen after ``step`` optimiser steps."""
    return step * float(batch_size * accumulation * world) / rows
