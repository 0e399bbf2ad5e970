"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through

K = 10
#: Vectors in one block of an annulus, about; queries that one task holds at a time.
BLOCK_ROWS = 4096
MAX_PIVOTS = 256
MAX_BLOCKS = 100_000
QUERY_ROWS = 20_000
VECTOR = "id long, vec binary, norm double"


def _quantized(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, norms = [], [], []
            for i, v in zip(batch.column("id"), batch.column("vec")):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x)
                ids.append(i.as_py())
                out.append(q.astype(np.int64).tobytes())
                norms.append(float((q * q).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], names=["id", "vec", "norm"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones count as 0 in what they lack."""
    raw = [np.frombuffer(b.as_buffer(), np.int64) for b in column]
    out = np.zeros((len(raw), dim), dtype=np.int64)
    for k, v in enumerate(raw):
        out[k, : len(v)] = v
    return out


def _distances(rows: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances to pivots in the space with one more coordinate, in which the best score is the nearest."""
    a = np.hstack([rows.astype(np.float64), lift[:, None]])
    b = np.hstack([pivots.astype(np.float64), pivot_lift[:, None]])
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


class Index:
    """Pivots and the vectors keyed by nearest pivot and distance, written in blocks of sorted annuli.

    Inner product turns into distance by a further coordinate that lifts all vectors to one length. Pivots
    are a bounded sample: the vectors of least hash, ``MAX_PIVOTS`` at most. Every vector is
    indexed. A block is a piece of one annulus of one pivot; vectors of one distance are dealt by hash, so
    repeated vectors fill many blocks.
    """

    def __init__(self, vectors: DataFrame, block_rows: int = BLOCK_ROWS):
        spark = vectors.sparkSession
        self.rows, top, longest = vectors.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.length("vec"))).first()
        self.dim, self.top = int(longest or 0) // 8, float(top or 0.0)
        self.block_rows = max(block_rows, math.ceil(self.rows / MAX_BLOCKS))
        count = min(MAX_PIVOTS, max(1, self.rows // 1024))
        sample = vectors.select("vec", "norm").orderBy(F.xxhash64("vec")).limit(count).toArrow()
        self.pivots = _matrix(sample.column("vec").combine_chunks(), self.dim)
        self.pivot_lift = self.lift(sample.column("norm").to_numpy())
        shared = spark.sparkContext.broadcast((self.pivots, self.pivot_lift))
        dim, lift = self.dim, self.lift

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, pivot_lift = shared.value
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                far = _distances(_matrix(batch.column("vec"), dim), lift(batch.column("norm").to_numpy()), pivots, pivot_lift)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vec"), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])],
                    names=["id", "vec", "pivot", "far"],
                )

        keyed = write_through(vectors.mapInArrow(key, "id long, vec binary, pivot int, far double"), "keyed")
        cells = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("cell_rows"), F.percentile_approx("far", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
        # at most 64 annuli for each pivot, fewer for small cells; a fuller annulus is dealt by hash
        rings = F.least(F.lit(64), F.greatest(F.lit(1), F.expr(f"cast(cell_rows div {self.block_rows} AS int)")))
        ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("far"))) * F.col("rings") / 64).cast("int")
        ringed = keyed.join(F.broadcast(cells.withColumn("rings", rings)), "pivot").withColumn("ring", ring)  # one row for each pivot
        filled = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("ring_rows"))
        salts = F.expr(f"greatest(1, cast(ceil(ring_rows / {self.block_rows}) AS int))")
        placed = ringed.select("id", "vec", "far", "pivot", "ring").join(F.broadcast(filled.withColumn("salts", salts)), ["pivot", "ring"])
        block = F.xxhash64("pivot", "ring", F.pmod(F.xxhash64("id", "vec"), "salts"))
        self.vectors = write_through(placed.select(block.alias("block"), "pivot", "far", "id", "vec"), "blocks")
        # at most MAX_BLOCKS blocks and a ring more for each pivot
        blocks = self.vectors.groupBy("block", "pivot").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).toArrow()
        self.blocks = {c: blocks.column(c).to_numpy() for c in ("block", "pivot", "low", "high", "n")}

    @property
    def lift(self):
        top = self.top
        return lambda norm: np.sqrt(np.maximum(top - norm, 0.0))


FOUND = "query_id long, vec_id long, score long"


def _assign(index: Index, shared, k: int, first_round: bool, chunks: int):
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, pivot_lift, blocks, top = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = _matrix(part.column("vec"), dim)
                far = _distances(rows, np.zeros(len(rows)), pivots, pivot_lift)[:, blocks["pivot"]]
                # triangle inequality: a query is at least so far from all that a block holds
                bound = np.maximum(np.maximum(far - blocks["high"], blocks["low"] - far), 0.0)
                order = np.argsort(bound, axis=1, kind="stable")
                sorted_n = np.cumsum(blocks["n"][order], axis=1)
                home = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(home, order, np.concatenate([np.zeros((len(rows), 1)), sorted_n[:, :-1]], axis=1) <= 2 * k, axis=1)
                if first_round:
                    wanted = home
                else:
                    norm = (rows.astype(np.float64) ** 2).sum(axis=1)
                    least = part.column("least").to_numpy(zero_copy_only=False)
                    reach = np.sqrt(np.maximum(norm + top - 2 * least, 0.0))  # nan where there are fewer than k so far
                    slack = 1e-6 * (1.0 + np.sqrt(norm + top))
                    wanted = ~home & ~(bound > (reach + slack)[:, None])
                q, b = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks["block"][b]),
                        pa.array((part.column("chunk").to_numpy(zero_copy_only=False)[q]).astype(np.int32)),
                        part.column("id").take(pa.array(q)),
                        part.column("vec").take(pa.array(q)),
                        part.column("least").take(pa.array(q)),
                    ],
                    names=["block", "chunk", "id", "vec", "least"],
                )

    return run


def _search_block(dim: int, top: float, k: int):
    exact_floats = top < 2**50  # every product sum is then a whole number that a double holds

    def run(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        none = pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names=names)
        if q.num_rows == 0 or v.num_rows == 0:
            return none
        out = [none]
        mine = _matrix(v.column("vec").combine_chunks(), dim)
        ids = v.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
        known = v.column("id").is_valid().to_numpy()
        right = mine.T.astype(np.float64) if exact_floats else mine.T
        for lo in range(0, q.num_rows, 512):
            part = q.slice(lo, 512)
            asked = _matrix(part.column("vec").combine_chunks(), dim)
            who = part.column("id").to_numpy()
            scores = (asked.astype(np.float64) @ right).astype(np.int64) if exact_floats else asked @ right
            hit_q, hit_v = [], []
            for r in range(len(who)):
                s = scores[r]
                good = np.flatnonzero(~(known & (ids == who[r])))
                least = part.column("least")[r].as_py()
                if least is not None:
                    good = good[s[good] >= least]
                if len(good) > k:
                    good = good[s[good] >= np.partition(s[good], len(good) - k)[len(good) - k]]
                    good = good[np.lexsort((ids[good], -s[good]))[:k]]
                hit_q.append(np.full(len(good), r))
                hit_v.append(good)
            a, b = np.concatenate(hit_q), np.concatenate(hit_v)
            out.append(pa.Table.from_arrays([pa.array(who[a]), v.column("id").combine_chunks().take(pa.array(b)), pa.array(scores[a, b])], names=names))
        return pa.concat_tables(out)

    return run


def top_k(
    vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k best scores of each query, a row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Components become floor(scale * x); the score is the integer inner product; ties go to the smaller
    id, a null id last. A row is no candidate of a query of its id. Vectors that are null or hold null or non-finite
    components take no part; shorter vectors count as 0 in what they lack. Rows that
    repeat are candidates each; a query that repeats is one query. Fewer than k candidates give all.

    Round one searches the annuli nearest to the query until they hold 2k vectors; the k-th score found
    bounds how far a better vector can lie. Round two searches all annuli that the triangle
    inequality does not exclude. Each meeting is of one block of vectors and one chunk of queries.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    clean = write_through(rows.mapInArrow(_quantized(scale), VECTOR), "vectors")
    index = Index(clean, block_rows)
    spark = vectors.sparkSession
    queries = clean.where((F.col("id") % every) == 0).select("id", "vec").dropDuplicates(["id", "vec"])
    chunks = max(1, math.ceil(index.rows / every / QUERY_ROWS))
    queries = queries.withColumns({"chunk": F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"), "least": F.lit(None).cast("long")})
    shared = spark.sparkContext.broadcast((index.pivots, index.pivot_lift, index.blocks, index.top))
    blocks = index.vectors.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "id", "vec")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())

    def search(asked: DataFrame, first: bool) -> DataFrame:
        dealt = asked.mapInArrow(_assign(index, shared, k, first, chunks), "block long, chunk int, id long, vec binary, least long")
        found = dealt.groupBy("block", "chunk").cogroup(blocks.groupBy("block", "chunk")).applyInArrow(_search_block(index.dim, index.top, k), FOUND)
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = write_through(search(queries, True).select("query_id", "vec_id", "score"), "round_one")
    least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
    again = queries.drop("least").join(least, F.col("id") == F.col("query_id"), "left").select("id", "vec", "chunk", "least")
    second = search(again, False).select("query_id", "vec_id", "score")
    return (
        first.unionByName(second)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
