"""Checkpoints of runs as a stream: a save every so many steps, of which the last few stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = T.StructType([T.StructField("saved", T.ArrayType(T.LongType())), T.StructField("newest_ms", T.LongType())])


def save_events(
    log: DataFrame, every: int, keep: int, run: str = "run", step: str = "step", ts: str | None = None,
    idle_minutes: int | None = None, late: str = "10 minutes",
) -> DataFrame:
    """``run, step, event`` of a stream of log rows: ``save`` for each step that ``every`` divides, ``drop`` when it no longer is one of the last ``keep``.

    A run's state is the steps it keeps, ``keep`` of them at most, so a run of any length costs the same; other rows leave before the
    shuffle. Steps may come in any order: one that comes after ``keep`` greater ones is saved and dropped at once. A
    repeated step says nothing new while it is kept, and is saved and dropped again after that; null steps save nothing, and a null run
    is a run. With ``idle_minutes``, a run without a save for so long by the column ``ts`` is ``closed`` (null step) and its state
    goes; rows later than ``late`` are then left out, and a run that goes on after its end starts with nothing kept.
    """
    if every < 1 or keep < 1:
        raise ValueError("every and keep are 1 at least")
    if idle_minutes is not None and not ts:
        raise ValueError("idle runs are told by a time column")
    rows = log.select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), *([F.col(ts).cast("timestamp").alias("ts")] if ts else []))
    rows = rows.where(F.pmod("step", F.lit(every)) == 0)
    timeout = GroupStateTimeout.NoTimeout
    if idle_minutes is not None:
        rows, timeout = rows.withWatermark("ts", late), GroupStateTimeout.EventTimeTimeout
    rows = rows.withColumn("ms", F.unix_millis("ts") if ts else F.lit(None).cast("long"))
    idle_ms = None if idle_minutes is None else idle_minutes * 60_000

    def events(key: tuple, fresh: np.ndarray, dropped: np.ndarray) -> pd.DataFrame:
        # one plain frame a call: frames of their own for saves and drops cost more than the steps
        return pd.DataFrame({
            "run": np.array([key[0]] * (len(fresh) + len(dropped)), dtype=object),
            "step": np.concatenate([fresh, dropped]),
            "event": np.array(["save"] * len(fresh) + ["drop"] * len(dropped), dtype=object),
        })

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run": pd.Series([key[0]], dtype=object), "step": pd.array([None], dtype="Int64"), "event": "closed"})
            return
        kept, newest = state.get if state.exists else ([], None)
        kept = np.array(kept, np.int64)
        for batch in batches:
            fresh = np.setdiff1d(batch["step"].to_numpy(np.int64), kept)
            every_step = np.union1d(kept, fresh)
            kept, dropped = every_step[-keep:], every_step[:-keep]
            if len(fresh) or len(dropped):
                yield events(key, fresh, dropped)
            times = batch["ms"].dropna() if ts else ()
            if len(times):
                newest = max(int(times.max()), newest or 0)
        state.update(([int(x) for x in kept], newest))
        if idle_ms is not None and newest is not None:
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))

    kind = log.schema[run].dataType
    out = T.StructType([T.StructField("run", kind), T.StructField("step", T.LongType()), T.StructField("event", T.StringType())])
    return rows.groupBy("run").applyInPandasWithState(advance, out, STATE, "append", timeout)


def saves_of(events: DataFrame) -> DataFrame:
    """``run, step, kept`` of all saves among written events; the number of kept saves of a run is ``keep`` at most."""
    saves = events.where("event IN ('save', 'drop')")
    return saves.groupBy("run", "step").agg((~F.bool_or(F.col("event") == "drop")).alias("kept"))
