"""Keys that more than one holder has, found exactly once and remembered in a filter of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mix64

#: Bits of the filter: 8 MB in memory and as a broadcast, whatever the corpus. A fuller filter lets
#: more lone keys pass to the exact step behind it; it never holds a repeated key back.
BITS = 26
PACKED = "slice int, data binary"


def spread(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.uint64(0xA0761D6478BD642F))


def _shorten(shorts: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as compressed differences, byte by byte."""
    steps = np.diff(shorts, prepend=np.uint32(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _lengthen(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _ends(keys: np.ndarray) -> np.ndarray:
    """The first and the last entry of each run of equal keys."""
    change = keys[1:] != keys[:-1]
    return np.concatenate([[True], change]) | np.concatenate([change, [True]])


def pack(keys: np.ndarray, holders: np.ndarray, slice_bits: int, lone: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each slice of the key space: 32 further bits of each key, and its holder.

    A key's holders within the call shrink to the least and the greatest, so a frequent key takes
    two entries of each call, not one of each holder. ``lone`` marks entries whose holder has no other entry of
    that key in any call; they go without their holder.
    """
    lone = np.zeros(len(keys), dtype=bool) if lone is None else lone
    mixed = spread(keys)
    named, holders, bare = mixed[~lone], holders[~lone], np.sort(mixed[lone])
    order = np.lexsort((holders, named))
    named, holders = named[order], holders[order]
    if len(named):
        keep = _ends(named)
        named, holders = named[keep], holders[keep]
    if len(bare):
        bare = bare[_ends(bare)]

    def split(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = (mixed >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(mixed), np.int64)
        short = ((mixed << np.uint64(slice_bits)) >> np.uint64(32)).astype(np.uint32)
        return short, np.searchsorted(part, np.arange((1 << slice_bits) + 1))

    (short, cuts), (bare, bare_cuts) = split(named), split(bare)
    rows, data = [], []
    for s in range(1 << slice_bits):
        a, b, c, d = cuts[s], cuts[s + 1], bare_cuts[s], bare_cuts[s + 1]
        if a < b or c < d:
            rows.append(s)
            head = np.array([b - a, d - c], dtype=np.uint32).tobytes()
            data.append(head + short[a:b].tobytes() + holders[a:b].astype(np.uint64).tobytes() + (_shorten(bare[c:d]) if c < d else b""))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(data, pa.binary())], names=["slice", "data"])


def slice_bits_for(keys: int, each: int = 1_500_000) -> int:
    """Slices that hold about ``each`` keys, as a power of two; their number grows with the data."""
    return max(0, int(np.ceil(np.log2(max(keys, 1) / each)))) if keys > each else 0


def repeated(packed: DataFrame, slice_bits: int, bits: int = BITS, hot: int | None = None) -> np.ndarray:
    """The filter of keys with at least two holders, from rows of ``pack``.

    With ``hot`` a second filter follows: keys with so many entries, of which a call of ``pack`` makes
    two at most.
    """
    bits = max(bits, slice_bits + 3)
    cell_bits = bits - slice_bits

    def sift(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorts, holders, bare = [], [], []
        for batch in batches:
            for data in batch.column("data"):
                raw = data.as_py()
                n, m = np.frombuffer(raw, np.uint32, 2).tolist()
                shorts.append(np.frombuffer(raw, np.uint32, n, 8))
                holders.append(np.frombuffer(raw[8 + 4 * n : 8 + 12 * n], np.uint64))
                if m:
                    bare.append(_lengthen(raw[8 + 12 * n :], m))
        holder = np.concatenate(holders)
        short = np.concatenate(shorts + bare)
        alone = np.arange(len(short)) >= len(holder)
        least = np.concatenate([holder, np.full(len(short) - len(holder), ~np.uint64(0))])
        greatest = np.where(alone, np.uint64(0), least)
        order = np.argsort(short, kind="stable")
        short, alone, least, greatest = short[order], alone[order], least[order], greatest[order]
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        entries, bare_ones = np.diff(np.append(first, len(short))), np.add.reduceat(alone.astype(np.int64), first)
        known = entries > bare_ones
        two = known & (np.minimum.reduceat(least, first) != np.maximum.reduceat(greatest, first))
        live = [two | (bare_ones + known >= 2)]
        if hot:
            live.append(entries >= hot)
        piece = b""
        for chosen in live:
            marks = np.zeros(1 << cell_bits, dtype=bool)
            marks[short[first[chosen]] >> np.uint32(32 - cell_bits)] = True
            piece += np.packbits(marks, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([piece], pa.binary())], names=["slice", "data"])

    out = np.zeros((2 if hot else 1, 1 << (bits - 3)), dtype=np.uint8)
    width = 1 << (cell_bits - 3)
    # one piece of the filter for each slice: its size is that of the filter; all slices are sifted at once, and a job brings 4 MB
    sifted = packed.groupBy("slice").applyInArrow(sift, PACKED).repartition(max(1, out.nbytes >> 22))
    for row in sifted.toLocalIterator():
        out[:, row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(bytes(row["data"]), dtype=np.uint8).reshape(-1, width)
    return out if hot else out[0]


def may_repeat(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may have two holders."""
    bits = int(len(marks) * 8).bit_length() - 1
    cell = spread(keys) >> np.uint64(64 - bits)
    return (marks[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def members(rows: DataFrame, column: str, bits: int = 24, hashed: bool = False) -> np.ndarray:
    """A filter of the hashes of a column's values: at most 2**bits / 64 words reach the driver."""
    cell = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(1 << bits))
    words = (
        rows.select(cell.alias("cell"))
        .groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS int))")).alias("marks"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("marks").to_numpy().astype(np.int64).view(np.uint64)
    return out


def is_member(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether values whose xxhash64 is given may be among the members."""
    cell = np.mod(hashes.astype(np.int64), np.int64(len(marks) * 64)).astype(np.uint64)
    return (marks[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
