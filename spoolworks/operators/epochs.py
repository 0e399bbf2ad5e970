"""A new order for every epoch, computed row by row: no sort, no shuffle, and any step can be resumed.

Positions 0 to rows - 1 are written as pairs of a grid of about root by root. Rounds of a Feistel network add a
hash of one half to the other, modulo the grid's side, so the grid is mapped onto itself one to one. A position that lands on one
of the few places of the grid beyond the rows is mapped again until it lands within.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Fewer than one in root-of-rows places lie beyond the rows, so that many walks in a row fail for no table; if they did, it would be an error.
WALKS = 32


def grid_of(rows: int) -> tuple[int, int]:
    """Sides of the least grid of equal sides, less whole lines, that holds the rows."""
    a = math.isqrt(max(rows, 1) - 1) + 1
    return a, -(-max(rows, 1) // a)


def _hash(epoch: Column, half: Column, turn: Column, seed: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _map_once(x: Column, epoch: Column, a: int, b: int, seed: int, back: bool) -> Column:
    start = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))
    turns = list(range(ROUNDS))[:: -1 if back else 1]

    def add(value: Column, change: Column, side: int) -> Column:
        moved = F.pmod(change, F.lit(side).cast("long"))
        return F.pmod(value - moved if back else value + moved, F.lit(side).cast("long"))

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, add(s["l"], _hash(epoch, s["r"], i, seed), a)).otherwise(s["l"])
        right = F.when(i % 2 == 1, add(s["r"], _hash(epoch, s["l"], i, seed), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.array(*map(F.lit, turns)), start, turn, lambda s: s["l"] * b + s["r"])


def _walk(x: Column, rows: int, epoch: Column, seed: int, back: bool) -> Column:
    a, b = grid_of(rows)
    x, epoch = x.cast("long"), epoch.cast("long")
    again = F.sequence(F.lit(2), F.lit(WALKS))
    landed = F.aggregate(
        again, _map_once(x, epoch, a, b, seed, back), lambda y, _: F.when(y < rows, y).otherwise(_map_once(y, epoch, a, b, seed, back)),
        lambda y: F.when(y < rows, y).otherwise(F.raise_error(F.lit("a position walked beyond the rows")).cast("long")),
    )
    inside = F.when((x >= 0) & (x < rows), landed).otherwise(F.raise_error(F.lit(f"positions go from 0 to {rows - 1}")).cast("long"))
    return F.when(x.isNull() | epoch.isNull(), F.lit(None).cast("long")).otherwise(inside)


def epoch_rank(position: Column, rows: int, epoch: Column, seed: int = 42) -> Column:
    """Where the row at ``position`` of the table stands in an epoch's order; null if position or epoch is null, an error outside of the table."""
    return _walk(position, rows, epoch, seed, back=False)


def epoch_position(rank: Column, rows: int, epoch: Column, seed: int = 42) -> Column:
    """The inverse: the position in the table of the row that stands at ``rank`` of an epoch's order."""
    return _walk(rank, rows, epoch, seed, back=True)


def reshuffled(df: DataFrame, position: str, rows: int, epochs: int, seed: int = 42, resume: tuple[int, int] = (0, 0)) -> DataFrame:
    """Every row once for each epoch, with ``epoch`` and its ``rank`` there; rows before ``resume`` (epoch, rank) are left out.

    Epochs count from 0. Positions are unique and go from 0 to ``rows`` - 1, as ``input_rank`` gives them once. Rows stay in their
    tasks, in no order; sort a step's few rows by rank, or write them bucketed by step. An empty table gives an empty table; columns
    named epoch and rank are replaced.
    """
    first, behind = resume
    kept = df.drop(*[c for c in df.columns if c.lower() in ("epoch", "rank") and c != position])
    if first >= epochs:
        return kept.withColumns({"epoch": F.lit(0).cast("int"), "rank": F.lit(0).cast("long")}).where(F.lit(False))
    at = F.col(position).alias("__position")
    every = kept.select(*[c for c in kept.columns if c.lower() not in ("epoch", "rank")], at, F.explode(F.array(*map(F.lit, range(first, epochs)))).alias("epoch"))
    ranked = every.withColumn("rank", epoch_rank(F.col("__position"), rows, F.col("epoch"), seed)).drop("__position")
    return ranked.where((F.col("epoch") > first) | (F.col("rank") >= behind)) if behind else ranked
