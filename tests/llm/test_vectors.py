"""Exact top k against all pairs."""

import math

import numpy as np
import pytest

from spoolworks.llm import vectors
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k=10):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = set()
    for q, v in {(i, tuple(v)) for i, v in good if i is not None and i % every == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w)), i is None, i, n) for n, (i, w) in enumerate(good) if i != q]
        out |= {(q, r + 1, i, -s) for r, (s, _, i, _) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


def compare(spark, rows, every, **options):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = vectors.top_k(frame, every=every, **options).collect()
    assert {tuple(r) for r in got} == brute(rows, every)


@pytest.mark.parametrize("block_rows", [4096, 50])
def test_random_ties_and_hot_vectors(spark, block_rows, monkeypatch):
    rng = np.random.default_rng(block_rows)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(1500)]
    rows += [(1500 + i, [0.5] * 8) for i in range(700)]
    compare(spark, rows, 50, block_rows=block_rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [None, 1.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [1.0]), (4, []), (None, [1.0, 2.0]), (5, [-1.0, -2.0]), (400, [3.0, 3.0])]
    compare(spark, rows, 100)
    assert vectors.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.top_k(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-(2**20), 2**20, 4) * 1.0).tolist()) for i in range(300)]
    compare(spark, rows, 50)


def test_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op10_topk"](spark, FOLDER).collect()} == brute(rows, 100)
