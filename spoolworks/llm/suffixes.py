"""Repeated passages: every byte under a string of 100 bytes that also starts earlier.

Strings are only compared where they can be equal. Each string of 100 bytes has an anchor, its least
hashed 24-gram; anchors held once drop out, and the strings of the others meet at their anchor's
hash and are suffix-sorted there, deep-shallow: multikey quicksort by symbols of eight bytes to a shallow
depth, then blind tries for those that still tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from . import sieve
from .arrow import mix64, slices
from .common import whole
from .exact import drop_exact_duplicates

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1  # grams of one string
SHALLOW = 32
#: Texts longer than this are read in parts that overlap by a string less a byte.
PART_BYTES = 2 << 20
BUNDLE_BYTES = 8 << 20
WINDOWS = 150_000
#: An anchor met in so many slices (two entries each at most) is dealt by single strings instead of by
#: anchor, so that no task has to hold its contexts: below, they are at most those of some GB of text.
HOT_ENTRIES = 4000
LAST = np.iinfo(np.int64).max  # the place of null ids in the order
B = 0x9E3779B97F4A7C15


def _anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places and hashes, and the first and last start of the strings that each anchor has.

    ``valid`` marks starts of strings. Ties between grams go to the left one, so equal strings
    have their anchor at the same place within them.
    """
    code = mix64(data.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    level, width = code, 1
    for _ in range(4):  # 2, 4, 8, 16 bytes
        level = level[:-width] * np.uint64(pow(B, width, 1 << 64)) + level[width:]
        width *= 2
        if width == 8:
            eight = level
    grams = mix64(level[: len(data) - GRAM + 1] * np.uint64(pow(B, 8, 1 << 64)) + eight[16 : 16 + len(data) - GRAM + 1])
    low = np.uint64(0xFFFFFF)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: len(grams) - SPAN + 1], best[SPAN - width :])
    starts = np.flatnonzero(valid[: len(best)])
    at = (best[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(at) else np.empty(0, np.int64)
    last = np.append(new[1:], len(starts)) - 1
    return at[new], grams[at[new]], starts[new], starts[last] if len(new) else new


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of texts: data, valid starts, row of each byte, place of each byte in its text."""
    raw = [t.as_buffer() if t.is_valid else b"" for t in column]
    pending, size = [], 0

    def joined(pieces):
        data = np.concatenate([d for _, d, _ in pieces])
        rows = np.repeat([r for r, _, _ in pieces], [len(d) for _, d, _ in pieces])
        places = np.concatenate([np.arange(len(d)) + o for _, d, o in pieces])
        valid = np.concatenate([np.arange(len(d)) + LENGTH <= len(d) for _, d, _ in pieces])
        return data, valid, rows, places

    for row, buffer in enumerate(raw):
        data = np.frombuffer(buffer, dtype=np.uint8)
        for at in range(0, max(len(data) - LENGTH + 1, 0), PART_BYTES):
            piece = data[at : at + PART_BYTES + LENGTH - 1]
            pending.append((row, piece, at))
            size += len(piece)
            if size >= PART_BYTES // 2:
                yield joined(pending)
                pending, size = [], 0
    if pending:
        yield joined(pending)


def _tags(column: pa.Array) -> list[bytes]:
    return [xxhash.xxh3_128_digest(t.as_buffer()) if t.is_valid else b"" for t in column]


def _least_rows(batch: pa.RecordBatch, tags: list[bytes]) -> np.ndarray:
    """Whether each row has the least id of its text in the batch, null ids being last."""
    ids = pc.fill_null(batch.column("id"), LAST).to_pylist()
    least: dict[bytes, int] = {}
    for tag, i in zip(tags, ids):
        least[tag] = min(i, least.get(tag, LAST))
    return np.array([least[t] == i for t, i in zip(tags, ids)], dtype=bool)


def _pack_anchors(slice_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "text", PART_BYTES):
                salts = np.array([xxhash.xxh3_64_intdigest(t) for t in _tags(batch.column("text"))], dtype=np.uint64)
                keys, holders = [], []
                for data, valid, rows, places in _parts(batch.column("text")):
                    at, key, _, _ = _anchors(data, valid)
                    keys.append(key)
                    holders.append(mix64(salts[rows[at]] + places[at].astype(np.uint64)))
                if keys and sum(map(len, keys)):
                    yield sieve.pack(np.concatenate(keys), np.concatenate(holders), slice_bits)

    return run


PACK = "bundle int, size int, pack binary"
RANGE = "tag binary, first int, n int"
#: Bytes of contexts that a task gathers before it packs them by bundle.
PACK_BYTES = 24 << 20


class _Packs:
    """Contexts of anchors, gathered and then packed and compressed by bundle.

    A context has its anchor's key, the place ``rel`` of its first string from the anchor, the place
    ``first`` of that string in the text, the number ``n`` of strings and, unless it is settled as a
    repeat already, the bytes under them.
    """

    def __init__(self, bundles: int):
        self.bundles, self.parts, self.ids, self.tags, self.size = bundles, [], [], [], 0

    def add(self, key, rel, first, n, text, data, settled, ids, tags) -> None:
        self.parts.append((key, rel, first, n, text + len(self.ids), data, settled))
        self.ids += ids
        self.tags += tags
        self.size += len(data)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        key, rel, first, n, text, _, settled = (np.concatenate(x) if k != 5 else None for k, x in enumerate(zip(*self.parts)))
        data = np.concatenate([p[5] for p in self.parts])
        length = np.where(settled, 0, n + LENGTH - 1)
        begin = np.cumsum(length) - length
        bundle = (mix64(key) % np.uint64(self.bundles)).astype(np.int64)
        order = np.argsort(bundle, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], bundle[order][1:] != bundle[order][:-1], [True]]))
        ids, tags = np.array(self.ids, dtype=np.int64), np.frombuffer(b"".join(self.tags), dtype=np.uint8).reshape(-1, 16)
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = order[lo:hi]
            texts, local = np.unique(text[own], return_inverse=True)
            head = np.array([len(own), len(texts)], dtype=np.int32)
            columns = [head, key[own], ids[texts], tags[texts], first[own].astype(np.int32), local.astype(np.int32), rel[own].astype(np.int8), n[own].astype(np.int8), settled[own].astype(np.int8), data[_ranges(begin[own], length[own])]]
            raw = b"".join(c.tobytes() for c in columns)
            out.append((int(bundle[own[0]]), len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bundle", "size", "pack"])
        self.__init__(self.bundles)


def _unpack(batches: Iterator[pa.RecordBatch]):
    """Arrays of the contexts of a bundle: key, rel, first, n, settled, text, bytes; and of their texts: ids, tags."""
    columns, ids, tags, known, pieces = [[] for _ in range(6)], [], [], {}, []
    for batch in batches:
        for size, pack in zip(batch.column("size").to_pylist(), batch.column("pack")):
            raw = pa.decompress(pack.as_buffer(), decompressed_size=size, codec="zstd", asbytes=True)
            m, t = np.frombuffer(raw, np.int32, 2).tolist()
            at, views = 8, []
            for kind, count in ((np.uint64, m), (np.int64, t), (np.uint8, 16 * t), (np.int32, m), (np.int32, m), (np.int8, m), (np.int8, m), (np.int8, m)):
                views.append(np.frombuffer(raw, kind, count, at))
                at += views[-1].nbytes
            own = [raw[8 + 8 * m + 8 * t + 16 * k : 8 + 8 * m + 8 * t + 16 * (k + 1)] for k in range(t)]
            numbers = np.empty(t, dtype=np.int64)
            for k, (tag, i) in enumerate(zip(own, views[1].tolist())):
                if tag not in known:
                    known[tag] = len(ids)
                    ids.append(i)
                    tags.append(tag)
                numbers[k] = known[tag]
            for c, x in zip(columns, (views[0], views[5], views[3], views[6], views[7] != 0, numbers[views[4]])):
                c.append(x.astype(np.int64) if x.dtype.kind == "i" else x)
            pieces.append(raw[at:])
    return (*[np.concatenate(c) for c in columns], np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array(ids, dtype=np.int64), tags)


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _contexts(filters, bundles: int):
    """Contexts of anchors that may repeat. Of equal ones in a slice one goes on with its bytes; the others
    are repeats already, and only said to be so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, hots = filters.value
        packs = _Packs(bundles)
        for whole_batch in batches:
            for batch in slices(whole_batch, "text", PART_BYTES):
                tags = _tags(batch.column("text"))
                ids = pc.fill_null(batch.column("id"), LAST).to_numpy(zero_copy_only=False)
                for data, valid, rows, places in _parts(batch.column("text")):
                    at, key, first, last = _anchors(data, valid)
                    live = sieve.may_repeat(marks, key)
                    at, key, first, n = at[live], key[live], first[live], (last - first + 1)[live]
                    hot = sieve.may_repeat(hots, key)
                    if hot.any():  # dealt by each of their strings
                        times = np.where(hot, n, 1)
                        who = np.repeat(np.arange(len(key)), times)
                        first = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                        at, key, n, hot = at[who], key[who].copy(), np.where(hot, 1, n)[who], hot[who]
                        raw = data.tobytes()
                        key[hot] = [xxhash.xxh3_64_intdigest(raw[f : f + LENGTH], int(k) & 0xFFFFFFFF) for f, k in zip(first[hot].tolist(), key[hot])]
                    if len(key) == 0:
                        continue
                    text, place, length = rows[first], places[first], n + LENGTH - 1
                    index = _ranges(first, length)
                    body = data[index]
                    ends = np.cumsum(length)
                    joined, settled = body.tobytes(), np.zeros(len(key), dtype=bool)
                    best: dict[tuple, int] = {}
                    order = lambda k: (int(ids[text[k]]), tags[text[k]], int(place[k]))
                    for k, (x, e, m, r) in enumerate(zip(key.tolist(), ends.tolist(), length.tolist(), (first - at).tolist())):
                        name = (x, r, joined[e - m : e])
                        other = best.setdefault(name, k)
                        if other != k:
                            if order(k) < order(other):
                                best[name], other = k, other
                                settled[other] = True
                            else:
                                settled[k] = True
                    used, local = np.unique(text, return_inverse=True)
                    packs.add(
                        key, first - at, place, n, local, body[~np.repeat(settled, length)], settled, ids[used].tolist(), [tags[t] for t in used.tolist()]
                    )
                    if packs.size >= PACK_BYTES:
                        yield from packs.rows()
        yield from packs.rows()

    return run


def _split(group: np.ndarray, *within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and then ``within``, and where parts begin in that order."""
    order = np.lexsort((*within[::-1], group))
    new = np.ones(len(order), dtype=bool)
    new[1:] = group[order][1:] != group[order][:-1]
    for w in within:
        new[1:] |= w[order][1:] != w[order][:-1]
    return order, new


def equal_strings(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sorting: strings (by number) in sorted order that have an equal one in their group, and new group numbers.

    ``at`` are starts in ``data``; strings of different groups are not compared.
    """
    pad = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    symbols = np.ndarray(shape=(len(pad) - 7,), dtype=">u8", buffer=pad, strides=(1,))
    who = np.arange(len(at))

    def keep_ties(order, new):
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        tied = size[number] > 1
        return order[tied], number[tied]

    order, number = keep_ties(*_split(group))
    who = who[order]
    # multikey quicksort: one symbol splits every group, groups of one are done
    for depth in range(0, SHALLOW, 8):
        if len(who) == 0:
            return who, who
        order, number = keep_ties(*_split(number, symbols[at[who] + depth].astype(np.uint64)))
        who = who[order]
    # blind tries: a group branches where its strings first differ, skipping what they share
    done_who, done_group, next_group = [], [], 0
    while len(who):
        rows = data[at[who][:, None] + np.arange(SHALLOW, LENGTH)]
        heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        own = np.cumsum(np.concatenate([[True], number[1:] != number[:-1]])) - 1
        differs = rows != rows[heads][own]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
        branch = np.minimum.reduceat(first, heads)
        leaf = branch[own] == LENGTH
        if leaf.any():
            done_who.append(who[leaf])
            done_group.append(own[leaf] + next_group)
            next_group += len(heads)
        who, own, rows, branch = who[~leaf], own[~leaf], rows[~leaf], branch[own[~leaf]] if len(heads) else branch
        if len(who) == 0:
            break
        order, number = keep_ties(*_split(own, rows[np.arange(len(who)), branch]))
        who = who[order]
    if not done_who:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(done_who), np.concatenate(done_group)


def _repeats(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bundle of anchors: ranges of starts of strings that start earlier elsewhere."""
    keys, rel, first, n, settled, text, data, ids, tags = _unpack(batches)
    # tags in byte order, so that ties of ids go the same way everywhere
    rank = np.empty(len(tags), np.int64)
    rank[sorted(range(len(tags)), key=tags.__getitem__)] = np.arange(len(tags))
    found = [(text[settled], first[settled], n[settled])]
    live = ~settled
    keys, rel, first, n, text = keys[live], rel[live], first[live], n[live], text[live]
    length = n + LENGTH - 1
    begin = np.cumsum(length) - length

    offsets = np.append(begin, len(data)).astype(np.int64)
    bodies = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    codes = bodies.dictionary_encode().indices.to_numpy()
    order, new = _split(keys, rel, codes)
    same = np.cumsum(new) - 1
    order = order[np.lexsort((first[order], rank[text[order]], ids[text[order]], same))]
    found.append((text[order[~new]], first[order[~new]], n[order[~new]]))
    rows = order[new]

    # different contexts of one anchor: their single strings are sorted
    size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], keys[rows][1:] != keys[rows][:-1]])), len(rows))) if len(rows) else np.empty(0, np.int64)
    rows = rows[np.repeat(size > 1, size)]
    if len(rows):
        # whole anchors, until about WINDOWS strings are together
        new_key = np.concatenate([[True], keys[rows][1:] != keys[rows][:-1]])
        block = np.maximum.accumulate(np.where(new_key, np.cumsum(n[rows]) // WINDOWS, 0))
        for lo, hi in _runs(block):
            who = np.repeat(rows[lo:hi], n[rows[lo:hi]])
            step = _ranges(np.zeros(hi - lo, np.int64), n[rows[lo:hi]])
            group = mix64(keys[who] + mix64((rel[who] + step + SPAN).astype(np.uint64)))
            hit, equal = equal_strings(data, begin[who] + step, group)
            if len(hit) == 0:
                continue
            owner, place = text[who[hit]], first[who[hit]] + step[hit]
            by = np.lexsort((place, rank[owner], ids[owner], equal))
            later = by[np.concatenate([[False], equal[by][1:] == equal[by][:-1]])]
            later = later[np.lexsort((place[later], owner[later]))]
            t, p = owner[later], place[later]
            if len(t):
                cut = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] > p[:-1] + 1)]))
                ends = np.append(cut[1:], len(t)) - 1
                found.append((t[cut], p[cut], p[ends] - p[cut] + 1))
    owner, start, count = (np.concatenate(x) for x in zip(*found))
    yield pa.RecordBatch.from_arrays(
        [pa.array(tags, pa.binary()).take(pa.array(owner)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["tag", "first", "n"]
    )


def _runs(block: np.ndarray):
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _candidates_of_texts(marks):
    """Per row: id, tag, bytes, digest of the whole text, and the text itself if it may lose some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "text", PART_BYTES):
                tags = _tags(batch.column("text"))
                least = _least_rows(batch, tags)
                raw = [t.as_buffer() if t.is_valid else b"" for t in batch.column("text")]
                hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in tags], dtype=np.uint64).view(np.int64)
                hit = sieve.is_member(marks.value, hashes) & least if len(tags) else least
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(tags, pa.binary()),
                        pa.array([len(r) for r in raw], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                        pa.array([bytes(r) if h else None for r, h in zip(raw, hit.tolist())], pa.binary()),
                    ],
                    names=["id", "tag", "n_bytes", "whole_sha256", "raw"],
                )

    return run


def _cut(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "raw", PART_BYTES):
                out = [_cut_one(row, with_kept) for row in zip(*(batch.column(c).to_pylist() for c in ("id", "n_bytes", "whole_sha256", "raw", "least", "firsts", "ns")))]
                kinds = [batch.schema.field("id").type, pa.int64(), pa.int64(), SPANS, pa.string(), pa.binary()]
                columns = zip(*out) if out else [[]] * 6
                fields = [([{"start": a, "end": b} for a, b in s] for s in c) if k is SPANS else c for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(fields, kinds)], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


def _cut_one(row: tuple, with_kept: bool) -> tuple:
    i, size, sha, raw, least, firsts, ns = row
    if size >= LENGTH and least is not None and (LAST if i is None else i) != least:  # a later copy
        return i, size, size, [(0, size)], hashlib.sha256(b"").hexdigest(), b"" if with_kept else None
    if size < LENGTH or not firsts:
        return i, size, 0, [], sha, None
    change = np.zeros(size + 1, dtype=np.int32)
    begin, length = np.array(firsts), np.array(ns)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + length + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
    return i, size, int(gone.sum()), list(zip(edges[::2].tolist(), edges[1::2].tolist())), hashlib.sha256(kept).hexdigest(), kept if with_kept else None


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
CUT = "n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept binary"


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_entries: int = HOT_ENTRIES, with_kept: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (removed runs), kept_sha256, kept (null: the whole text, or not asked for).

    A byte goes if a string of 100 bytes over it also starts earlier: in a document of smaller id or
    further left in its own. Null texts are empty; null ids come last; texts that share an id
    are ordered by a hash, and rows that repeat id and text are one document and get the same answer.
    Texts of fewer than 100 bytes lose nothing. An empty table gives an empty table.

    Equal texts are told by a 128-bit hash: a later copy goes as a whole and takes no part
    otherwise. No text moves unless it loses bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slice_bits = sieve.slice_bits_for(total // 39, 1_500_000)  # about two anchors for every 78 bytes
    sc = docs.sparkSession.sparkContext
    # each text once, in its first document: what later copies hold is told of them as a whole
    once = drop_exact_duplicates(plain, "id", "text", largest=False)
    filters = sc.broadcast(sieve.repeated(once.select("text").mapInArrow(_pack_anchors(slice_bits), sieve.PACKED), slice_bits, hot=hot_entries))
    bundles = max(8, int(total // BUNDLE_BYTES) + 1)
    rows = once.mapInArrow(_contexts(filters, bundles), PACK)
    ranges = rows.groupBy("bundle").applyInArrow(_repeats, RANGE)
    # all ranges of one text: no more than the text has strings
    lost = write_through(ranges.groupBy("tag").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("ns")), "ranges")

    tags_only = lambda batches: (
        pa.RecordBatch.from_arrays([pc.fill_null(b.column("id"), LAST).cast(pa.int64()), pa.array(_tags(b.column("text")), pa.binary())], names=["id", "tag"])
        for batch in batches
        for b in slices(batch, "text")
    )
    copies = plain.mapInArrow(tags_only, "id long, tag binary").groupBy("tag").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    facts = write_through(copies.select("tag", "least").join(lost, "tag", "full"), "repeats")
    marks = sc.broadcast(sieve.members(lost.mapInArrow(_tag_hashes, "hash long"), "hash", hashed=True))
    texts = plain.mapInArrow(_candidates_of_texts(marks), f"id {kind}, tag binary, n_bytes long, whole_sha256 string, raw binary")
    other = facts.withColumnRenamed("tag", "of_tag")
    joined = texts.join(other, F.col("tag") == F.col("of_tag"), "left").select("id", "n_bytes", "whole_sha256", "raw", "least", "firsts", "ns")
    return joined.mapInArrow(_cut(with_kept), f"id {kind}, {CUT}").withColumnRenamed("id", id_col)


def _tag_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = np.array([xxhash.xxh3_64_intdigest(t.as_py()) for t in batch.column("tag")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64())], names=["hash"])


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut_repeats(docs, id_col, text_col, with_kept=False).select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
