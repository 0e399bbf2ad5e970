"""Sampled segmentations into SentencePiece pieces, and their lossless decoding.

Forward filtering sums over the lattice of pieces of every distinct chunk of text; backward sampling
draws a segmentation for each of its places, from random numbers that depend on the row's key and the
place alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import mix64, slices
from .common import free

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
SPACE = 0x2581  # the mark that stands for a blank in pieces
OWN_MARK = 0x110000  # the same character where the text itself has it; no piece holds it
SLICE_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PREFIX_BITS, BUCKET_BITS = 21, 18
BEGINS, WHOLE = 1, 2  # marks of hashes: of the beginning of a piece, of a whole one


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _codes(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))


def _hash_of(points: np.ndarray) -> np.uint64:
    return (_codes(points) * _powers(BASE, len(points))).sum(dtype=np.uint64)


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def load_model(path: str = MODEL, alpha: float = ALPHA) -> dict:
    """Piece tables of a model file, read on the driver.

    A unigram model gives log probabilities. The pieces of a BPE model only have ranks; Zipf's law
    makes log probabilities of them. ``alpha`` scales them: at 1 segmentations are drawn by their
    probability, smaller values give more variety.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)])
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    bytes_at = np.full(256, -1, dtype=np.int32)
    for i in range(n):
        if model.is_byte(i):
            bytes_at[int(model.id_to_piece(i)[3:5], 16)] = i
    if (bytes_at < 0).any():
        raise ValueError("the model has no pieces for bytes, so not every text can be encoded")
    ranked = bool((np.diff(np.sort(-scores[normal])) >= 1).all())
    rank = np.empty(len(normal))
    rank[np.argsort(-scores[normal], kind="stable")] = np.arange(len(normal))
    zipf = 1.0 / (rank + 10.0)
    weights = alpha * (np.log(zipf / zipf.sum()) if ranked else scores[normal])
    texts = [model.id_to_piece(i) for i in normal]
    if any("▁" in p.lstrip("▁") for p in texts):
        raise ValueError("a piece of the model goes on past a blank")
    points = [np.array([ord(c) for c in p]) for p in texts]
    hashes = np.array([_hash_of(p) for p in points], dtype=np.uint64)
    order = np.argsort(hashes)
    if (np.diff(hashes[order]) == 0).any():
        raise ValueError("two pieces of the model have the same hash")
    prefixes = np.zeros(1 << PREFIX_BITS, dtype=np.uint8)
    for p in points:
        upto = np.cumsum(_codes(p) * _powers(BASE, len(p)), dtype=np.uint64)
        prefixes[_top(upto, PREFIX_BITS)] |= BEGINS
    prefixes[_top(hashes, PREFIX_BITS)] |= WHOLE
    in_bucket = np.bincount(_top(hashes, BUCKET_BITS), minlength=1 << BUCKET_BITS)
    # a character without a piece costs its bytes; these entries follow those of the pieces
    byte_weight = float(weights.min()) - 1.0
    surface = [b""] * n
    for i, p in zip(normal, texts):
        surface[i] = p.replace("▁", " ").encode()
    for b in range(256):
        surface[bytes_at[b]] = bytes([b])
    return {
        "hashes": hashes[order],
        "ids": np.array(normal, dtype=np.int32)[order],
        "weights": weights[order],
        "costs": np.concatenate([weights[order], byte_weight * np.arange(1, 5)]),
        "buckets": (np.cumsum(in_bucket) - in_bucket).astype(np.int32),
        "fullest": int(in_bucket.max()),
        "prefixes": prefixes,
        "longest": max(map(len, points)),
        "bytes": bytes_at,
        "byte_weight": byte_weight,
        "surface": np.frombuffer(b"".join(surface), dtype=np.uint8),
        "lengths": np.array([len(s) for s in surface], dtype=np.int64),
    }


def _utf8_sizes(points: np.ndarray) -> np.ndarray:
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size[points == OWN_MARK] = 3
    return size


class Chunks:
    """Texts as chunks: blanks and what follows up to the next blanks; the texts begin with a blank of their own."""

    def __init__(self, texts: list[str]):
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        joined = "".join(" " + t for t in texts if t)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        points[points == SPACE] = OWN_MARK
        points[points == 0x20] = SPACE
        self.points, self.text_ends = points, np.cumsum(lengths)
        begins = np.zeros(len(points), dtype=bool)
        if len(points):
            blank = points == SPACE
            begins[1:] = blank[1:] & ~blank[:-1]
            begins[(self.text_ends - lengths)[lengths > 0]] = True
        self.starts = np.flatnonzero(begins)
        self.sizes = np.diff(np.append(self.starts, len(points)))
        self.text = np.searchsorted(self.text_ends, self.starts, side="right")
        first = np.searchsorted(self.starts, self.text_ends - lengths)
        self.ordinal = np.arange(len(self.starts)) - first[self.text] if len(self.starts) else self.starts

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct chunk, and each chunk's number among them; equal hashes are compared."""
        offset = np.arange(len(self.points)) - np.repeat(self.starts, self.sizes)
        salt, powers = np.uint64(0), _powers(BASE, int(self.sizes.max()))
        while True:
            codes = mix64(self.points.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D) + salt) * powers[offset]
            hashes = np.add.reduceat(codes, self.starts) + self.sizes.astype(np.uint64)
            number = pa.array(hashes).dictionary_encode().indices.to_numpy()
            first = np.empty(number.max() + 1, dtype=np.int64)
            first[number[::-1]] = np.arange(len(number))[::-1]
            same = np.repeat(self.starts[first][number], self.sizes) + offset
            if (self.sizes[first][number] == self.sizes).all() and (self.points[np.minimum(same, len(self.points) - 1)] == self.points).all():
                return first, number
            salt += np.uint64(1)


def _columns(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of falling size, character by character: how many chunks have a first character, a second and so on; the offset of each."""
    width = len(sizes) - np.cumsum(np.bincount(sizes))[:-1]
    return width, np.repeat(np.arange(len(width)), width)


def _lattice(points: np.ndarray, sizes: np.ndarray, model: dict):
    """Edges over distinct chunks by end, shorter ones first, bytes last: how many end at each place, start, end, weight, piece, offset of each place.

    Chunks stand by falling size; ``points`` has the first characters of all of them, then the second of those that have two
    and so on. Places (before, between and after characters) go the same way: all entries of chunks, then what follows each
    character. So the edges into a place stand behind those into all places before it in its chunk, and nothing is sorted.
    """
    n, total = len(sizes), len(points)
    kind = np.int32 if n + total < 1 << 31 else np.int64
    width, offset = _columns(sizes)
    last = np.append(width[1:], 0)
    after = np.arange(total, dtype=kind) + width.astype(kind)[offset]  # the next character of the chunk, -1 behind its last one
    after[np.arange(total) - (np.cumsum(width) - width)[offset] >= last[offset]] = -1
    entry = np.concatenate([[0], n - width[:-1]]).astype(kind)[offset] + np.arange(total, dtype=kind)  # the place before a character
    codes, hashes = _codes(points), model["hashes"]
    start = at = np.arange(total, dtype=kind)
    part, powers, runs = codes, _powers(BASE, model["longest"]), []
    for length in range(1, model["longest"] + 1):
        if length > 1:
            at = after[at]
            room = np.flatnonzero(at >= 0)
            start, at = start[room], at[room]
            part = part[room] + codes[at] * powers[length - 1]
        mark = model["prefixes"][_top(part, PREFIX_BITS)]
        maybe = np.flatnonzero(mark & WHOLE)
        wanted = part[maybe]
        piece = model["buckets"][_top(wanted, BUCKET_BITS)]
        hit = hashes[np.minimum(piece, len(hashes) - 1)] == wanted
        for k in range(1, model["fullest"]):
            miss = np.flatnonzero(~hit)
            more = np.minimum(piece[miss] + k, len(hashes) - 1)
            found = hashes[more] == wanted[miss]
            piece[miss[found]] = more[found]
            hit[miss[found]] = True
        maybe, piece = maybe[hit], piece[hit]
        runs.append((entry[start[maybe]], at[maybe], piece))
        if length == 1:
            covered = np.zeros(total, dtype=bool)
            covered[maybe] = True
        live = np.flatnonzero(mark & BEGINS)
        start, at, part = start[live], at[live], part[live]
        if len(at) == 0:
            break
    bare = np.flatnonzero(~covered).astype(kind)
    runs.append((entry[bare], bare, (len(hashes) + _utf8_sizes(points[bare]) - 1).astype(np.int32)))
    count = np.zeros(total, dtype=np.int32)
    for _, end, _ in runs:
        count[end] += 1
    free_at = np.cumsum(count) - count
    begin, pieces = np.empty(int(count.sum()), dtype=kind), np.empty(int(count.sum()), dtype=np.int32)
    while runs:  # the ends of a run differ, so each of its edges has a slot of its own
        some, end, piece = runs.pop(0)
        slot = free_at[end]
        begin[slot], pieces[slot] = some, piece
        free_at[end] += 1
    end = np.repeat(np.arange(n, n + total, dtype=kind), count)
    return count, begin, end, model["costs"][pieces], pieces, np.concatenate([np.zeros(n, dtype=np.int64), offset + 1])


def _forward(n_places: int, first: np.ndarray, begin, end, weight, offset) -> np.ndarray:
    """The log sum over all ways from a chunk's first place to each place; ``offset`` is that of an edge's end.

    All chunks go on together, a place at a time: the edges come as the lattice has them. The edges into a place are summed in
    the order of their begins, from its last edge to its first, so no sum depends on the other chunks.
    """
    sums = np.full(n_places, -np.inf)
    sums[first] = 0.0
    heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
    cuts = np.flatnonzero(np.concatenate([[True], offset[heads][1:] != offset[heads][:-1], [True]]))
    upto = np.append(heads, len(end))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        lo, hi = upto[a], upto[b]
        ways = sums[begin[lo:hi]] + weight[lo:hi]
        sums[end[heads[a:b]]] = np.logaddexp.reduceat(ways[::-1], hi - upto[a + 1 : b + 1][::-1])[::-1]
    return sums


def encode(texts: list[str], keys: np.ndarray, model: dict, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and the end of each text's ids. Keys are 64-bit."""
    chunks = Chunks(texts)
    if len(chunks.starts) == 0:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    first, number = chunks.distinct()
    falling = np.argsort(-chunks.sizes[first], kind="stable")
    rank = np.empty_like(falling)
    rank[falling] = np.arange(len(falling))
    first, number = first[falling], rank[number]
    sizes, n = chunks.sizes[first], len(first)
    width, column = _columns(sizes)
    before = np.cumsum(width) - width
    points = chunks.points[chunks.starts[first][np.arange(len(column)) - before[column]] + column]
    count, begin, end, weight, piece, offset = _lattice(points, sizes, model)
    sums = _forward(n + len(points), np.arange(n), begin, end, weight, offset[end])

    # running shares of a place's sum; every place but the entries has edges
    share = weight
    share += sums[begin]
    share -= sums[end]
    upto = np.exp(share, out=share)
    heads = np.cumsum(count) - count
    last = heads + count - 1
    at = heads  # summed place by place, so that no sum depends on the other chunks of the slice
    for k in range(1, int(count.max())):
        at = heads[count > k] + k
        upto[at] += upto[at - 1]
    upto /= np.repeat(upto[last], count)
    upto[last] = 1.0

    row = mix64(keys.astype(np.uint64) ^ mix64(np.array([seed + 1], np.uint64)))[chunks.text]
    row = mix64(row + chunks.ordinal.astype(np.uint64) * BASE)
    steps = np.zeros(len(number), dtype=np.int64)
    who, step, taken = np.arange(len(number)), 0, []
    place = before[sizes - 1][number] + number  # without the entries, that is the place after the last character
    while len(who):
        u = (mix64(row + np.uint64((step + 1) * int(BASE_INVERSE) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        edge = heads[place]  # the first edge of the place whose running share exceeds u
        behind = np.flatnonzero(upto[edge] <= u)
        while len(behind):
            edge[behind] += 1
            behind = behind[upto[edge[behind]] <= u[behind]]
        taken.append((who, edge))
        steps[who] += 1
        place = begin[edge]
        more = np.flatnonzero(place >= n)
        who, row, place, step = who[more], row[more], place[more] - n, step + 1
    ends = np.cumsum(steps)
    edges = np.empty(ends[-1], dtype=np.int64)
    for k, (w, e) in enumerate(taken):
        edges[ends[w] - 1 - k] = e

    # edges to ids; a character without a piece becomes its bytes
    chosen = piece[edges]
    bare = chosen >= len(model["ids"])
    width = np.ones(len(edges), dtype=np.int64)
    width[bare] = chosen[bare] - len(model["ids"]) + 1
    out = np.empty(width.sum(), dtype=np.int32)
    at = np.cumsum(width) - width
    out[at[~bare]] = model["ids"][chosen[~bare]]
    for i in np.flatnonzero(bare):
        point = int(points[end[edges[i]] - n])
        raw = chr(SPACE if point == OWN_MARK else point).encode("utf-8", "surrogatepass")
        out[at[i] : at[i] + width[i]] = model["bytes"][list(raw)]
    of_text = np.bincount(np.repeat(chunks.text, steps), weights=width, minlength=len(texts)).astype(np.int64)
    return out, np.cumsum(of_text)


def decode(ids: np.ndarray, ends: np.ndarray, model: dict) -> list[bytes]:
    """The texts in UTF-8. The first blank of a text is the encoder's own."""
    lengths = model["lengths"][ids]
    upto = np.cumsum(lengths)
    origin = np.cumsum(model["lengths"]) - model["lengths"]
    index = np.repeat(origin[ids] - (upto - lengths), lengths) + np.arange(lengths.sum())
    raw = model["surface"][index].tobytes()
    cuts = np.concatenate([[0], np.concatenate([[0], upto])[ends]]).tolist()
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(cuts, cuts[1:])]


def _model_on(df: DataFrame, path: str, alpha: float):
    return df.sparkSession.sparkContext.broadcast(load_model(path, alpha))


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str = "tokens", seed: int = 0, path: str = MODEL, alpha: float = ALPHA, keep: list[str] | None = None
) -> DataFrame:
    """Adds an array of piece ids to documents; every row stays, and every column or those of ``keep`` (one of the result's name is replaced).

    Only the columns that stay come back from Python, so leave out the text where it is not needed.

    The same id, text and seed always give the same segmentation, however the rows are dealt; rows that repeat an
    id get the same random numbers. Null and empty texts have no pieces. Whole texts are encoded;
    memory is bounded by slices of 256 KB (some 40 MB where all words differ) or one text.
    """
    model = _model_on(docs, path, alpha)
    (key,) = free(docs, "row_key")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != tokens_col.lower()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(tokens_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                texts = pc.fill_null(part.column(text_col), "").to_pylist()
                ids, ends = encode(texts, part.column(key).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), model.value, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [lists], names=[*keep, tokens_col])

    rows = docs.withColumn(key, F.xxhash64(F.col(id_col)))
    need = list(dict.fromkeys([*keep, text_col, key]))
    return rows.select(*need).mapInArrow(run, schema)


def decode_tokens(rows: DataFrame, tokens_col: str = "tokens", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """Adds the text of an array of piece ids; null decodes to the empty text. Other columns stay."""
    model = _model_on(rows, path, 1.0)
    keep = [c for c in rows.columns if c.lower() != text_col.lower()]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(tokens_col)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = decode(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.binary()).cast(pa.string())], names=[*keep, text_col])

    return rows.mapInArrow(run, schema)


def encoded_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, path: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """Per document: id, n_tokens, tokens_sha256 (ids as little-endian 32-bit), text_sha256 of the decoded text, lossless."""
    model = _model_on(docs, path, alpha)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                ids, ends = encode(texts, part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), model.value, seed)
                back = decode(ids, ends, model.value)
                cuts = np.concatenate([[0], ends]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(np.diff(cuts)),
                        pa.array([hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(cuts, cuts[1:])]),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                        pa.array([b == t.encode() for b, t in zip(back, texts)]),
                    ],
                    names=["id", "n_tokens", "tokens_sha256", "text_sha256", "lossless"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("key"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, tokens_sha256 string, text_sha256 string, lossless boolean").withColumnRenamed("id", id_col)
