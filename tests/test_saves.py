"""Saves of runs from a stream of steps."""

import random
from collections import defaultdict

import pandas as pd
import pytest

from spoolworks.streaming.jobs import run_available, stream_files
from spoolworks.streaming.saves import save_events, saves_of

SCHEMA = "run string, step long, ts timestamp, saved int"


def put(spark, folder, rows):
    frame = spark.createDataFrame([(r, s, None, 0) for r, s in rows], SCHEMA).selectExpr("run", "step", "timestamp_seconds(step * 60) AS ts", "saved")
    frame.coalesce(1).write.mode("append").parquet(folder)


def wanted(rows, every, keep):
    steps = defaultdict(set)
    for r, s in rows:
        if s is not None and s % every == 0:
            steps[r].add(s)
    return {(r, s, s in sorted(found)[-keep:]) for r, found in steps.items() for s in found}


def test_saves_in_any_order_and_after_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    draw = random.Random(5)
    parts = [[(draw.choice(["a", "b", None]), draw.choice([None, *range(-6, 90)])) for _ in range(60)] for _ in range(4)]
    for part in parts[:3]:
        put(spark, source, part)
    put(spark, source, [])
    stream = lambda: save_events(stream_files(spark, source, spark.read.parquet(source).schema, max_files=1), every=3, keep=2)
    run_available(stream(), out, check)
    first = spark.read.parquet(out)
    assert {tuple(r) for r in saves_of(first).collect()} == wanted(sum(parts[:3], []), 3, 2)
    # behind its checkpoint the stream knows what it kept
    put(spark, source, parts[3])
    run_available(stream(), out, check)
    events = spark.read.parquet(out)
    assert {tuple(r) for r in saves_of(events).collect()} == wanted(sum(parts, []), 3, 2)
    saves, drops = (events.where(f"event = '{e}'").count() for e in ("save", "drop"))
    assert saves - drops == 6, "each of three runs keeps two"


def test_a_long_run_in_one_batch_and_no_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(0, 300_000, 1, 1).selectExpr("'hot' AS run", "id AS step").write.parquet(source)
    run_available(save_events(stream_files(spark, source, spark.read.parquet(source).schema), 1000, 5), str(tmp_path / "out"), str(tmp_path / "c"))
    kept = saves_of(spark.read.parquet(str(tmp_path / "out")))
    assert kept.count() == 300 and sorted(r.step for r in kept.where("kept").collect()) == [295_000, 296_000, 297_000, 298_000, 299_000]
    spark.range(0).selectExpr("'x' AS run", "id AS step").write.parquet(str(tmp_path / "none"))
    empty = stream_files(spark, str(tmp_path / "none"), spark.read.parquet(source).schema)
    run_available(save_events(empty, 10, 1), str(tmp_path / "out0"), str(tmp_path / "c0"))
    with pytest.raises(ValueError):
        save_events(empty, 0, 1)
    with pytest.raises(ValueError):
        save_events(empty, 1, 1, idle_minutes=5)


def test_idle_runs_are_closed(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    stream = lambda: save_events(
        stream_files(spark, source, spark.read.parquet(source).schema, max_files=1), every=10, keep=2, ts="ts", idle_minutes=30
    )
    put(spark, source, [("early", s) for s in range(0, 50)] + [("late", s) for s in range(0, 40)])
    put(spark, source, [("late", s) for s in range(40, 200)])
    put(spark, source, [("late", s) for s in range(200, 220)])
    run_available(stream(), out, check)
    events = spark.read.parquet(out)
    assert [tuple(r) for r in events.where("event = 'closed'").collect()] == [("early", None, "closed")]
    assert {tuple(r) for r in saves_of(events).where("kept").collect()} == {("early", 30, True), ("early", 40, True), ("late", 200, True), ("late", 210, True)}
    # the run goes on after its end: a new state
    put(spark, source, [("early", 300), ("late", 300)])
    run_available(stream(), out, check)
    kept = saves_of(spark.read.parquet(out)).where("kept").collect()
    assert {(r.run, r.step) for r in kept} == {("early", 30), ("early", 40), ("early", 300), ("late", 210), ("late", 300)}


def test_one_frame_for_each_run_and_batch(spark, monkeypatch):
    """The step as a task calls it: a frame of saves and drops together, and none where nothing happens."""
    held = []
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandasWithState", lambda self, advance, *more: held.append(advance))
    save_events(spark.range(1).selectExpr("id AS run", "id AS step"), every=1, keep=1)

    class State:
        hasTimedOut, exists, get = False, True, ([20], None)

        def update(self, value):
            self.get = value

    state, rows = State(), pd.DataFrame({"step": [10, 30, 20], "ms": [None] * 3})
    frames = list(held[0]((7,), iter([rows]), state))
    assert [[tuple(r) for r in f.itertuples(index=False)] for f in frames] == [[(7, 10, "save"), (7, 30, "save"), (7, 10, "drop"), (7, 20, "drop")]]
    assert state.get == ([30], None)
    assert list(held[0]((7,), iter([pd.DataFrame({"step": [30], "ms": [None]})]), state)) == []
