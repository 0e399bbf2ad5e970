"""Near duplicates by Jaccard similarity of word shingles: size-banded tiles and bitmap signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from . import sieve
from .arrow import mix64, slices, words
from .common import free, whole
from .components import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Cells of the frequency sketch that orders shingles: 4 MB, whatever the corpus.
SKETCH_BITS = 22
SKETCH_PARTS = 64
#: Documents of one tile; larger groups become several tiles.
TILE = 20_000
GROUP_KEYS = 1_000_000
#: The filter of repeated keys has two cells for each key, 8 MB at least and 128 MB at most.
FILTER_BITS = 26, 30
#: Sets of possible links whose clusters, 32 bytes each, are sent to all tasks; more are joined by a shuffle.
SENT_SETS = 2_000_000
#: One element in so many is a key besides the first fifth. Linked sets share as many keys more, so a set
#: that only shares a passage or a chance key with others is told apart before anything else moves.
MORE_SHARE = 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one after the other, and where each begins."""
    distinct, word, starts = words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in distinct), dtype=np.uint64, count=len(distinct))[word]
    n = np.diff(starts)
    rolled = np.zeros(max(len(hashes) - SHINGLE + 1, 0), dtype=np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * FACTOR + hashes[k : k + len(rolled)]
    rolled = mix64(rolled)
    sets = []
    for a, m in zip(starts[:-1].tolist(), n.tolist()):
        if m >= SHINGLE:
            sets.append(np.unique(rolled[a : a + m - SHINGLE + 1]))
        elif m:
            few = hashes[a : a + m] * np.multiply.accumulate(np.full(m, FACTOR))
            sets.append(mix64(few.sum(keepdims=True) + np.uint64(m)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def tag_of(values: np.ndarray) -> int:
    """A signed 64-bit hash that stands for the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), len(values))).astype(np.int64))


def needed(a, b):
    """The least intersection at which sets of these sizes link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n):
    """Two linked sets share one of so many first elements in any common order."""
    return n - -(-PERCENT * n // 100) + 1


def more_keys(n):
    """With so many elements more, linked sets share so many more of their first elements."""
    return n // MORE_SHARE


def least_shared(n):
    """Least number of first elements that a set of n shares with any set it links with, the smaller one counting."""
    return 1 + more_keys(-(-PERCENT * n // 100))


def signature(values: np.ndarray, bits: int | None = None) -> bytes:
    """A bitmap of hashed elements, about one bit for each element unless it is given, 64 to 4096 bits."""
    bits = bits or min(4096, max(64, 1 << int(len(values) - 1).bit_length()))
    marks = np.zeros(bits, dtype=bool)
    marks[(values & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles counted by cell over the partition, in parts, as cell numbers and counts."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for batch in batches:
        for part in slices(batch, "text"):
            values, _ = shingle_sets(part.column("text"))
            cells, times = np.unique((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
            counts[cells] += times.astype(np.uint32)
    width = len(counts) // SKETCH_PARTS
    numbers, data = [], []
    for k in range(SKETCH_PARTS):
        own = counts[k * width : (k + 1) * width]
        at = np.flatnonzero(own)
        if len(at) == 0:
            continue
        small = len(at) * 6 < width * 2
        narrow = np.minimum(own, 65535).astype(np.uint16)
        numbers.append(k)
        data.append(b"s" + at.astype(np.uint32).tobytes() + narrow[at].tobytes() if small else b"d" + pa.compress(narrow.tobytes(), "zstd", asbytes=True))
    if numbers:
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["slice", "data"])


def _sketch_sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, dtype=np.int64)
    for batch in batches:
        for data in batch.column("data"):
            raw = data.as_py()
            if raw[:1] == b"d":
                total += np.frombuffer(pa.decompress(raw[1:], 2 * len(total), "zstd", asbytes=True), np.uint16)
            else:
                n = (len(raw) - 1) // 6
                total[np.frombuffer(raw[1 : 1 + 4 * n], np.uint32)] += np.frombuffer(raw[1 + 4 * n :], np.uint16)
    steps = np.ceil(4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([steps.tobytes()], pa.binary())], names=["slice", "total", "data"]
    )


def frequency_levels(docs: DataFrame) -> tuple[np.ndarray, float]:
    """A rank for every sketch cell and the usual count: 0 for up to that, 4 more for each doubling.

    Counts cover all documents. The order only decides which shingles serve as keys, frequent ones last.
    """
    rows = docs.select("text").mapInArrow(_sketch, sieve.PACKED).groupBy("slice").applyInArrow(_sketch_sum, "slice int, total long, data binary")
    steps = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    width, total = len(steps) // SKETCH_PARTS, 0
    for row in rows.toArrow().to_pylist():  # in one job: the sketch has a fixed size, a byte for each cell
        steps[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["data"], np.uint8)
        total += row["total"]
    usual = max(1.5 * total / len(steps), 2.0)
    floor = np.uint8(np.ceil(4 * np.log2(usual)))
    return np.maximum(steps, floor) - floor, usual


def _sets_table(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """Per document id, size and tag; the first document of a tag in a task also gets signature and keys."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, level = set(), shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                values, starts = shingle_sets(part.column("text"))
                sizes, tags, bits, keys = np.diff(starts), [], [], []
                for a, b in zip(starts[:-1], starts[1:]):
                    own = values[a:b]
                    tag = tag_of(own) if b > a else None
                    tags.append(tag)
                    if tag is None or tag in seen:
                        bits.append(None)
                        keys.append(None)
                        continue
                    seen.add(tag)
                    order = np.argsort(level[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    bits.append(signature(own))
                    keys.append(own[order[: prefix_length(len(own)) + more_keys(len(own))]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("hash"), pa.array(sizes), pa.array(tags, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "hash", "n", "tag", "bits", "keys"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", "text", F.xxhash64("text").alias("hash"))
    return rows.mapInArrow(run, f"id {kind}, hash long, n long, tag long, bits binary, keys array<long>")


def filter_bits(keys: int) -> int:
    """Bits of the filter for so many keys, as a power of two: a filter of one size would fill, and let ever more lone keys pass."""
    least, most = FILTER_BITS
    return min(most, max(least, int(2 * keys - 1).bit_length()))


def _pack_keys(slice_bits: int, several: np.ndarray):
    """Keys and their holders; a set that only one task found needs no name, each of its keys is a holder more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = sieve.is_member(several.value, batch.column("hash").to_numpy(zero_copy_only=False))
            lists = batch.column("keys")
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            holders = np.repeat(batch.column("tag").to_numpy(zero_copy_only=False), count).astype(np.int64).view(np.uint64)
            if len(keys):
                yield sieve.pack(keys, holders, slice_bits, np.repeat(~named, count))

    return run


def first_shared(live: np.ndarray, row: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the keys, in the common order of each row's set, may be the first that it shares with a set it links with.

    That key is among the first fifth of all elements, and others follow it: of ``least_shared(n)`` shared keys it is the
    first, so the last ``least_shared(n) - 1`` live ones are out, and a set with fewer live keys than that has none.
    """
    order = np.cumsum(live)
    counts = np.bincount(row[live], minlength=len(n))
    order -= (np.cumsum(counts) - counts)[row]  # from 1 within the row's live keys
    return live & (order <= (counts - least_shared(n) + 1)[row]) & (place < prefix_length(n)[row])


class Links:
    """Sets of linked nodes, joined as links are found."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Joins i with others; returns those that were in another set before, one of each set."""
        new = others[self.root[others] != self.root[i]]
        if len(new) == 0:
            return new
        roots, at = np.unique(self.root[new], return_index=True)
        self.root[np.isin(self.root, roots)] = self.root[i]
        return new[at]


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _may_link(a_bits, a_n, b_bits, b_n):
    """Bit counts bound the overlap from above: an element with a bit of its own is in one set only."""
    only_a = np.bitwise_count(a_bits & ~b_bits).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b_bits & ~a_bits).sum(axis=-1, dtype=np.int64)
    return np.minimum(a_n - only_a, b_n - only_b) >= needed(a_n, b_n)


def _tile_candidates(tags: np.ndarray, n: np.ndarray, bits: list[np.ndarray], groups: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of possible links that connect all possible links of the groups of set numbers."""
    links, out = Links(len(tags)), []
    widths = np.array([len(b) for b in bits])
    table = {}

    def at_width(rows: np.ndarray, width: int) -> np.ndarray:
        if width not in table:
            table[width] = np.zeros((len(tags), width), dtype=np.uint64)
            for w in np.unique(widths[widths >= width]):
                own = np.flatnonzero(widths == w)
                table[width][own] = _fold(np.stack([bits[i] for i in own]), width)
        return table[width][rows]

    def try_row(i: int, js: np.ndarray) -> None:
        js = js[(links.root[js] != links.root[i]) & (100 * n[i] >= PERCENT * n[js])]
        if len(js) == 0:
            return
        width = int(widths[i])  # js are at least as large, so their bitmaps are as wide or wider
        good = _may_link(at_width(np.array([i]), width), n[i], at_width(js, width), n[js])
        for j in links.join(i, js[good]):
            out.append((i, int(j)))

    small = [g for g in groups if len(g) <= 8]
    pairs = [np.stack(np.triu_indices(len(g), 1)).T for g in small]
    if pairs:
        both = np.unique(np.concatenate([g[p] for g, p in zip(small, pairs)]), axis=0)
        for i, js in zip(*_by_first(both)):
            try_row(i, js)
    for g in groups:
        if len(g) > 8:
            for k in range(len(g) - 1):
                if (links.root[g[k + 1 :]] == links.root[g[k]]).all():
                    continue
                try_row(int(g[k]), g[k + 1 :])
    return out


def _by_first(pairs: np.ndarray):
    first, cuts = np.unique(pairs[:, 0], return_index=True)
    return first.tolist(), np.split(pairs[:, 1], cuts[1:])


def _tile_lists(row: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The distinct rows, and the tiles of each, 32 bits of every one, as bytes.

    Tiles of a bundle that agree in those bits become one, which only adds pairs to compare.
    """
    order = np.argsort(row, kind="stable")
    rows, first = np.unique(row[order], return_index=True)
    data = pa.py_buffer((tiles[order] >> np.uint64(32)).astype(np.uint32).tobytes())
    ends = pa.py_buffer((4 * np.append(first, len(row))).astype(np.int32).tobytes())
    return rows, pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, data])


def _candidates(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bundle of tiles: sets that share a key meet, smaller sets first."""
    table = pa.Table.from_batches(list(batches))
    n_all, tag_all = table.column("n").to_numpy(), table.column("tag").to_numpy()
    lists = table.column("tiles").to_pylist()
    tile = np.frombuffer(b"".join(lists), np.uint32)
    # distinct sets, by size
    known, at, who = np.unique(tag_all, return_index=True, return_inverse=True)
    who = np.repeat(who, [len(x) // 4 for x in lists])
    order = np.argsort(n_all[at], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number = rank[who]
    at = at[order]
    by = np.lexsort((number, tile))
    tile, number = tile[by], number[by]
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = (tile[1:] != tile[:-1]) | (number[1:] != number[:-1])
    tile, number = tile[fresh], number[fresh]
    cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    groups = [g for g in np.split(number, cuts[1:]) if len(g) > 1]
    used = np.unique(np.concatenate(groups)) if groups else np.empty(0, np.int64)
    back = np.full(len(at), -1)
    back[used] = np.arange(len(used))
    column = table.column("bits")
    bits = [np.frombuffer(column[int(at[i])].as_py(), np.uint64) for i in used]
    tags, n = tag_all[at[used]], n_all[at[used]]
    links = _tile_candidates(tags, n, bits, [back[g] for g in groups])
    yield pa.RecordBatch.from_arrays(
        [pa.array([int(tags[i]) for i, _ in links], pa.int64()), pa.array([int(tags[j]) for _, j in links], pa.int64())], names=["high", "low"]
    )


def _verify(tags: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """True links that connect all true links of the sets, by intersection of sorted arrays.

    Sets come by size. Pairs that are joined already or that the finer bitmaps exclude are not intersected.
    """
    n = np.array([len(s) for s in sets])
    width = min(4096, max(64, 1 << int(2 * n.max()).bit_length()))
    bits = np.stack([np.frombuffer(signature(s, width), np.uint64) for s in sets])
    links, out = Links(len(sets)), []
    for i in range(len(sets) - 1):
        js = np.arange(i + 1, np.searchsorted(n, 100 * n[i] // PERCENT, side="right"))
        js = js[links.root[js] != links.root[i]]
        if len(js):
            js = js[_may_link(bits[i], n[i], bits[js], n[js])]
        for block in np.array_split(js, max(1, int(n[js].sum() // 4_000_000))):
            if len(block) == 0:
                continue
            joined = np.concatenate([sets[j] for j in block])
            place = np.minimum(np.searchsorted(sets[i], joined), n[i] - 1)
            hits = np.add.reduceat((sets[i][place] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(n[block])[:-1]]))
            for j in links.join(i, block[hits >= needed(n[i], n[block])]):
                out.append((int(tags[i]), int(tags[j])))
    return out


def _exact(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bundle of tiles of candidate clusters."""
    table = pa.Table.from_batches(list(batches))
    tile, tag, n = table.column("tile").to_numpy(), table.column("tag").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort((tag, n, tile))
    values = table.column("members").combine_chunks()
    found = []
    cuts = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1]]))
    for rows in np.split(order, cuts[1:]):
        rows = rows[np.concatenate([[True], tag[rows][1:] != tag[rows][:-1]])]
        if len(rows) > 1:
            found += _verify(tag[rows], [np.frombuffer(values[int(r)].as_buffer(), np.uint64) for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["high", "low"])


LINKS = "high long, low long"


def _candidate_links(sets: DataFrame, levels: np.ndarray, usual: float, tile: int) -> DataFrame:
    """Pairs of tags whose bitmaps allow a link and that connect all such pairs."""
    keyed = sets.where("keys is not null")
    total = keyed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    slice_bits = sieve.slice_bits_for(total)
    sc = sets.sparkSession.sparkContext
    found = keyed.groupBy("tag").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    several = sc.broadcast(sieve.members(found, "tag"))
    packed = keyed.select("tag", "keys", F.xxhash64("tag").alias("hash")).mapInArrow(_pack_keys(slice_bits, several), sieve.PACKED)
    marks = sieve.repeated(packed, slice_bits, filter_bits(total))
    shared, ranks = sc.broadcast(marks), sc.broadcast(levels)
    bundles = max(8, int(total // GROUP_KEYS) + 1)

    def spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each key that may be the first one shared with a linked set; sets of a very frequent key go to
        pairs of blocks of it."""
        for batch in batches:
            count = pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False)
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), count)
            live = sieve.may_repeat(shared.value, keys)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
            live = first_shared(live, row, place, n)
            keys, row = keys[live], row[live]
            level = ranks.value[(keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            blocks = np.maximum(1, np.ceil((2.0 ** (level / 4.0) - 1) * usual / tile)).astype(np.int64)  # by what is more than usual
            for lo in range(0, len(keys), 50_000):
                k, r, b = keys[lo : lo + 50_000], row[lo : lo + 50_000], blocks[lo : lo + 50_000]
                at = np.repeat(np.arange(len(k)), b)
                other = np.arange(len(at)) - np.repeat(np.cumsum(b) - b, b)
                tags = batch.column("tag").to_numpy(zero_copy_only=False)[r[at]]
                own = (mix64(tags.view(np.uint64)) % b[at].astype(np.uint64)).astype(np.int64)
                pair = (np.minimum(own, other) << 20) | np.maximum(own, other)
                tiles = mix64(k[at] ^ mix64(pair.astype(np.uint64)))
                bundle = (tiles % np.uint64(bundles)).astype(np.int64)
                # a set goes to a bundle once, with all its tiles there
                sent, lists = _tile_lists(bundle * batch.num_rows + r[at], tiles)
                bundle, owner = np.divmod(sent, batch.num_rows)
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bundle.astype(np.int32)), *(batch.column(c).take(owner) for c in ("tag", "n", "bits")), lists],
                    names=["bundle", "tag", "n", "bits", "tiles"],
                )

    rows = keyed.select("tag", "n", "bits", "keys").mapInArrow(spread_keys, "bundle int, tag long, n long, bits binary, tiles binary")
    return rows.groupBy("bundle").applyInArrow(_candidates, LINKS)


def _true_links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, tile: int) -> DataFrame:
    """Exact links within candidate clusters; a cluster above ``tile`` sets is banded by size and cut to pairs of blocks."""
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.first("root").alias("cluster")).drop("root")
    placed = clusters.join(sizes, F.col("root") == F.col("cluster")).select(F.col("node").alias("tag"), "cluster", "sets")
    chosen = sets.where("keys is not null").groupBy("tag").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    chosen = write_through(chosen.join(placed, "tag"), "cluster_sets")
    marks = docs.sparkSession.sparkContext.broadcast(sieve.members(chosen, "id"))
    count, elements = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bundles = max(8, int(elements // 2_000_000) + 1)
    placed = chosen.select("tag", "cluster", "sets")
    # elements then move once, to their bundle, not to their cluster's row first
    placed = F.broadcast(placed) if count <= SENT_SETS else placed

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = sieve.is_member(marks.value, batch.column("hash").to_numpy(zero_copy_only=False))
            for part in slices(batch.filter(pa.array(hit)), "text"):
                values, starts = shingle_sets(part.column("text"))
                own = [values[a:b] for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tag_of(v) if len(v) else None for v in own], pa.int64()), pa.array([v.tobytes() for v in own], pa.binary())],
                    names=["set_tag", "members"],
                )

    texts = docs.select(F.xxhash64("id").alias("hash"), "text").mapInArrow(read, "set_tag long, members binary")
    blocks = F.expr(f"cast(ceil(sets / {tile}) AS int)")
    band = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")
    rows = (
        texts.join(placed, F.col("set_tag") == F.col("tag"))
        .withColumn("n", F.expr("octet_length(members) div 8"))
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("tag"), "blocks"))
        .withColumn("band", F.explode(F.when(F.col("blocks") > 1, F.array(band, band + 1)).otherwise(F.array(F.lit(0)))))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("tile", F.xxhash64("cluster", "band", F.least("own", "other"), F.greatest("own", "other")))
        .select(F.pmod("tile", F.lit(bundles)).cast("int").alias("bundle"), "tile", "tag", "n", "members")
    )
    return rows.groupBy("bundle").applyInArrow(_exact, LINKS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Texts in ASCII lower case are sets of five-word shingles (fewer words: all of them as one), hashed to
    64 bits. Documents link when intersection over union is 0.8 or more; the component's id is the
    least id reachable by links (nulls do not count unless there is no other). Texts without words, null and
    empty ones among them, link with nothing. Repeated rows get a row each. An empty table gives an
    empty table.

    Sets that link share one of their first fifth of elements, rare ones first, and a twentieth of all among
    the first quarter. Keys that two sets hold make tiles for the sets with enough of them, save those that come too late to be the
    first one shared; within a tile a pair is left only if sizes and bitmaps allow a link. Such
    pairs join sets to clusters, and within clusters sorted arrays are intersected exactly,
    pairs already joined being left out. Equal sets are one set from the start.
    """
    return _grouped(docs, id_col, text_col, tile).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, tile: int) -> DataFrame:
    """id, hash (of the text), n, component_id, and first: whether the row is the one that its component keeps."""
    plain = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    levels, usual = frequency_levels(plain)
    sets = write_through(_sets_table(plain, levels), "shingle_sets")
    clusters = write_through(components(_candidate_links(sets, levels, usual, tile)), "clusters")
    joined = components(_true_links(plain, sets, clusters, tile))
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "hash")  # a null id is last
    least = sets.where("tag is not null").groupBy("tag").agg(F.min(place).alias("least"), F.first("tag").alias("set_tag")).drop("tag")
    rooted = least.join(joined, F.col("set_tag") == F.col("node"), "left").select("set_tag", "least", F.coalesce("root", "set_tag").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("kept"), F.first("root").alias("of_root")).drop("root")
    named = write_through(rooted.join(names, F.col("root") == F.col("of_root")).select("set_tag", "kept"), "components")
    return sets.join(named, F.col("tag") == F.col("set_tag"), "left").select(
        "id",
        "hash",
        "n",
        F.when(F.col("n") > 0, F.col("kept.id")).otherwise(F.col("id")).alias("component_id"),
        ((F.col("n") == 0) | (place == F.col("kept"))).alias("first"),
    )


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """The documents with one of each group of near duplicates, that of the least id; all columns stay.

    Of different texts under one id that of the least hash counts as the first. Rows that repeat id and text are one
    document and stay or go together. Texts without words all stay.
    """
    gone_id, gone_hash = free(docs, "gone_id", "gone_hash")
    gone = _grouped(docs, id_col, text_col, tile).where(~F.col("first")).select(F.col("id").alias(gone_id), F.col("hash").alias(gone_hash)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(whole(text_col)) == F.col(gone_hash))
    return docs.join(gone, same, "left_anti")
