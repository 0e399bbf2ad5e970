"""Near duplicates by SimHash: fingerprints, a grid over segment popcounts, and exact verification.

A fingerprint is mapped to the bit counts of its 32 segments of two bits. A differing bit moves one
count by at most one, so the Manhattan distance of two count vectors bounds the Hamming distance from
below. Fingerprints within Hamming distance d lie within Manhattan distance d: of m groups of segments
at most d differ, so some m - d groups have equal counts. The grid has one axis set for every choice of
m - d groups; a cell holds the fingerprints that agree there, and pairs meet in a cell. Inside, total
counts (again a Manhattan bound) limit the pairs whose bits are compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_through
from .arrow import slices
from .common import free
from .components import Forest, components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Shingles hashed at a time, so that a text of any length takes bounded memory.
HASH_BATCH = 1 << 15
#: Fingerprints of one cell that are compared in one task; a fuller cell is cut into pairs of blocks.
TILE = 4096
#: Fingerprints a cell holds on average at most, if they are spread evenly; more groups follow beyond.
CELL_ROWS = 1000
BUCKET_ROWS = 250_000
LOW_BITS = 0x5555555555555555
#: Hot cells that may be broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_CELLS = 100_000


def _hashes(words: list[bytes], start: int, stop: int, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    part = words[start : stop + width - 1]
    text = b" ".join(part)
    ends = list(itertools.accumulate(len(w) + 1 for w in part))
    begins = [0, *ends]
    return [xxh64_intdigest(text[a : b - 1], SEED) for a, b in zip(begins, ends[width - 1 :])]


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The SimHash of one text: a bit is 1 if it is set in over half the shingle hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASH_BATCH):
        hashed = np.array(_hashes(words, at, min(at + HASH_BATCH, n), width), dtype="<u8")
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``id, fp``: the fingerprint of every row's whole text as a signed long.

    Words are runs without blanks and the controls from tab to carriage return, A-Z count as a-z. Null
    and empty texts, and texts without words, have fingerprint 0; a text of fewer than ``width`` words is
    one shingle. Every row gives one row, repeated rows included; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.large_string()).cast(pa.large_binary())
                fps = np.array([fingerprint(t.as_py() or b"", width) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([kept.schema["id"], T.StructField("fp", T.LongType())])
    return kept.mapInArrow(run, schema)


def groups_for(rows: int, distance: int = DISTANCE) -> int:
    """The fewest groups of segments whose cells hold about ``CELL_ROWS`` of ``rows`` fingerprints at most.

    A segment of two bits has 1.5 bits of entropy, so ``m - distance`` of m groups tell 48 (m - distance) / m bits.
    """
    m = distance + 1
    while m < 16 and rows > CELL_ROWS * 2 ** (48 * (m - distance) / m):
        m += 1
    return m


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _counts(fp: Column) -> Column:
    """Bit counts of the 32 segments, each in its own two bits."""
    low = fp.bitwiseAND(F.lit(LOW_BITS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _cells(fps: DataFrame, m: int, distance: int) -> DataFrame:
    """Every fingerprint once in each of its cells: one for each choice of ``m - distance`` groups."""
    cuts = [32 * i // m for i in range(m + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(c) for c in itertools.combinations(masks, m - distance)]
    keys = [F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(_signed(mask))) for i, mask in enumerate(chosen)]
    return fps.select("fp", _counts(F.col("fp")).alias("counts")).select("fp", F.explode(F.array(*keys)).alias("cell"))


def _near_in_cells(fps: np.ndarray, cell: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, lesser node) that join all near fingerprints which share a cell."""
    total = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((total, cell))
    fps, cell, total = fps[order], cell[order], total[order]
    nodes, at = np.unique(fps, return_inverse=True)
    forest = Forest(len(nodes))
    live, gap = np.arange(len(fps) - 1), 1
    while len(live):
        live = live[live + gap < len(fps)]
        # in the order of cells and totals a pair that fails ends all wider ones
        live = live[(cell[live] == cell[live + gap]) & (total[live + gap] - total[live] <= distance)]
        near = live[np.bitwise_count(fps[live] ^ fps[live + gap]) <= distance]
        forest.join(at[near], at[near + gap])
        gap += 1
    return nodes, nodes[forest.root]


def _near_in_tile(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all near fingerprints of two blocks."""
    nodes = np.unique(np.concatenate([left, right]))
    forest = Forest(len(nodes))
    left, right = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (left, right))
    total = np.bitwise_count(right).astype(np.int64)
    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    for a in range(0, len(left), 64):
        some = left[a : a + 64]
        ends = np.bitwise_count(some[[0, -1]]).astype(np.int64)
        lo, hi = np.searchsorted(total, ends[0] - distance), np.searchsorted(total, ends[1] + distance, side="right")
        i, j = np.nonzero(np.bitwise_count(some[:, None] ^ right[None, lo:hi]) <= distance)
        forest.join(at_left[a + i], at_right[lo + j])
    return nodes, nodes[forest.root]


def near_links(fps: DataFrame, distance: int = DISTANCE, groups: int | None = None, tile: int = TILE) -> DataFrame:
    """``high, low``: links among distinct fingerprints ``fp`` that join any two within ``distance`` bits.

    No pair is lost, but inside a task links that others imply are not given, so that a cluster of k fingerprints
    gives about k links from each task and never k squared. A cell above ``tile`` rows is cut by a hash into
    blocks; every two blocks meet in a task of their own. ``fps`` is read twice: pass a written table.
    """
    rows = fps.count()
    m = groups or groups_for(rows, distance)
    cells = _cells(fps, m, distance)
    full = cells.groupBy("cell").count().where(F.col("count") > tile)
    full = write_through(full.select(F.col("cell").alias("full"), F.ceil(F.col("count") / tile).cast("int").alias("blocks")), "full_cells")
    buckets = max(1, math.ceil(rows * math.comb(m, distance) / BUCKET_ROWS))
    met = cells.join(F.broadcast(full) if full.count() <= BROADCAST_CELLS else full, F.col("cell") == F.col("full"), "left")
    none = F.lit(-1)
    light = met.where("full IS NULL").select(F.pmod("cell", F.lit(buckets)).alias("place"), none.alias("lo"), none.alias("hi"), none.alias("block"), "cell", "fp")
    own = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.col("blocks")).cast("int")
    heavy = (
        met.where("full IS NOT NULL")
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.col("cell").alias("place"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cell", "fp")
    )

    def link(key: tuple, batch: pa.Table) -> pa.Table:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        if key[1].as_py() < 0:
            node, root = _near_in_cells(fps, batch.column("cell").to_numpy(), distance)
        else:
            block = batch.column("block").to_numpy()
            node, root = _near_in_tile(fps[block == key[1].as_py()], fps[block == key[2].as_py()], distance)
        apart = node != root
        return pa.table({"high": node[apart].view(np.int64), "low": root[apart].view(np.int64)})

    return light.unionByName(heavy).groupBy("place", "lo", "hi").applyInArrow(link, "high long, low long")


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, groups: int | None = None, tile: int = TILE
) -> DataFrame:
    """One row for every row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Rows link when their fingerprints differ in ``distance`` bits at most; the component id is the least id
    reachable, the row's own included. Equal fingerprints are one node, so copies are never paired. Texts without words
    share fingerprint zero and link like any other. Repeated rows give repeated rows with equal answers; a null id is
    below no other, so a component of null ids alone has a null id. Other columns are not read; an empty
    table gives an empty one.
    """
    printed = write_through(fingerprints(docs, id_col, text_col), "simhash")
    nodes = write_through(printed.groupBy("fp").agg(F.min("id").alias("least")), "simhash_nodes")
    roots = components(near_links(nodes.select("fp"), distance, groups, tile))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = write_through(rooted, "simhash_roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.first("root").alias("top")).drop("root")
    answer = rooted.join(least, F.col("root") == F.col("top")).select(F.col("fp").alias("own"), "component_id")
    (name,) = free(docs.select(id_col), "fingerprint")
    return printed.join(answer, F.col("fp") == F.col("own")).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias(name), "component_id"
    )
