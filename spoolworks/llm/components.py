"""Connected components of links: blocks of links joined in their tasks, then large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through

#: Links that a task joins at once: 16 MB of them.
BLOCK = 1_000_000


class Forest:
    """Union of links among numbered nodes, by hooking roots to lesser roots."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _stars(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """Links (node, least node) that join what the links join."""
    nodes, at = np.unique(np.concatenate([high, low]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.join(at[: len(high)], at[len(high) :])
    own = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[forest.root[own]])], names=["high", "low"])


def _block_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of every block of the task's links."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        block = pa.Table.from_batches(held)
        held.clear()
        return _stars(block.column("high").to_numpy(), block.column("low").to_numpy())

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield joined()
    if held:
        yield joined()


def _least(pairs: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """The least value at each node; the node is copied so that a join deals both sides anew and can split a hub."""
    return pairs.groupBy(at).agg(F.least(F.first(at), F.min(value)).alias(name), F.first(at).alias("node")).drop(at)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("u", "v")
    least = _least(both, "u", "v", "m")
    return both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("high"), F.col("m").alias("low")).where("high != low").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _least(links, "high", "low", "m")
    met = links.join(least, F.col("high") == F.col("node")).select("low", "m").where("low != m").toDF("high", "low")
    return met.unionByName(least.select(F.col("node").alias("high"), F.col("m").alias("low"))).distinct()


def _open(links: DataFrame) -> int:
    """Nodes that hang on several nodes, or on one while others hang on them."""
    ends = links.select(F.col("high").alias("node"), F.lit(1).alias("hangs")).unionByName(links.select(F.col("low").alias("node"), F.lit(0).alias("hangs")))
    ways = ends.groupBy("node").agg(F.sum("hangs").alias("ways"), F.count(F.lit(1)).alias("links"))
    return ways.where("ways > 1 OR (ways = 1 AND links > 1)").count()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (high, low), both long, the root being the least node.

    A task first joins the links it has, in blocks of fixed size, so few links are left of a small table or of large
    components. Each round keeps the components and shortens the ways to the root; it ends when every node hangs
    on its root alone. Rounds are written to the shared folder. Roots have rows too.
    """
    links = links.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).where("high != low").distinct()
    links = write_through(links.mapInArrow(_block_stars, "high long, low long"), "links")
    while _open(links):
        links = write_through(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("low").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)
