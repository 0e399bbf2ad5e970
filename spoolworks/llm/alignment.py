"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of linked id pairs.

Every document is encoded by both tokenizers; a link is a pair of token occurrences whose byte ranges
overlap. Distinct pairs are numbered by a minimal perfect hash. How many documents hold each pair is a dense vector
indexed by that hash, filled block by block and summed as a tree. A second pass aligns the documents again and looks
the counts up, each against the key stored at its place.

Pairs are dealt by slices of the first id, so that the best count of an id is found within its slice. A slice
holds at most its share of (first vocabulary x second vocabulary) pairs, whatever the corpus. Nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, write_through
from .arrow import mix64, slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
SLICES = 64
SLICE_BYTES = 2 << 20
#: Blocks whose pairs of one slice meet in one task.
FAN_IN = 128
#: Words encoded as one string; words whose string is encoded at a time; words that a task remembers.
JOINED = 50
LEARN = 20_000
KNOWN_WORDS = 500_000
#: Tables of one slice that a step of a tree merges.
TREE = 16
#: Pair tables of at most so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: Cells for each key on every level of the perfect hash.
GAMMA = 2.0


# ---- vocabularies


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def load_byte_level(path: str = BYTE_BPE) -> dict:
    """A byte-level BPE file, read on the driver: its own JSON and the bytes of each id."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = f.read()
    model = Tokenizer.from_str(spec)
    letters = _byte_letters()
    special = {i: t.content.encode() for i, t in model.get_added_tokens_decoder().items()}
    names = {i: name for name, i in model.get_vocab().items()}
    table = [special[i] if i in special else bytes(letters[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
    return {"spec": spec, "bytes": table}


def load_pieces(path: str = PIECE_BPE) -> dict:
    """A SentencePiece file, read on the driver: its own bytes and the bytes of each id.

    Texts are cut before blanks, so no piece may hold its blank mark behind another character.
    """
    import sentencepiece

    with open(path, "rb") as f:
        spec = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=spec)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in name.lstrip("▁") for name in names):
        raise ValueError(f"{path} has pieces that cross blanks")
    table = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return {"spec": spec, "bytes": table}


class Encoder:
    """Both tokenizers of a task, opened once, and what is known of words already met."""

    def __init__(self, first: dict, second: dict):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first["spec"])
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second["spec"])
        self.tables = first["bytes"], second["bytes"]
        self.sizes = tuple(np.array([len(x) for x in t], dtype=np.int64) for t in self.tables)
        self.width, self.kinds = pair_width(second), tuple(map(id_kind, self.tables))
        n = max(map(len, self.tables))
        self.names = pa.array([f"{i}{end}".encode() for i in range(n) for end in (",", "|", ";", "")], pa.large_binary())
        self.known: dict[bytes, tuple] = {}

    def first_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank of their own."""
        return [e.ids for e in self.first.encode_batch(texts, add_special_tokens=False)]

    def second_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of the same texts; this tokenizer puts the leading blank itself."""
        return self.second.encode([t[1:] for t in texts], num_threads=1)

    def _one_by_one(self, words: list[bytes]) -> tuple[list, list, np.ndarray]:
        """Ids of each word by both, and whether a word is not what its tokens join to; such a word has none."""
        plain = [w.decode() for w in words]
        ids, wrong = (self.first_ids(plain), self.second_ids(plain)), np.zeros(len(words), dtype=bool)
        for part, table in zip(ids, self.tables):
            wrong |= np.array([b"".join([table[i] for i in x]) != w for x, w in zip(part, words)], dtype=bool)
        return *[[[] if bad else x for x, bad in zip(part, wrong.tolist())] for part in ids], wrong

    def _together(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Flat ids and ids a word by both, of words encoded ``JOINED`` at a time; None if a token crosses words."""
        joined = [b"".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        plain = [j.decode() for j in joined]
        ends, out = np.cumsum([len(w) for w in words]), []
        for encode, table, sizes in zip((self.first_ids, self.second_ids), self.tables, self.sizes):
            ids = encode(plain)
            if any(b"".join([table[i] for i in part]) != j for part, j in zip(ids, joined)):
                return None
            flat, _ = _flat(ids)
            token_ends = np.cumsum(sizes[flat])
            at = np.searchsorted(token_ends, ends)
            if len(words) and not (token_ends[at] == ends).all():
                return None
            out.append((flat, np.diff(at, prepend=-1)))
        return out

    def _learn(self, words: list[bytes]) -> None:
        # a word that ends in white space could take part of the next word's blanks
        joinable = [w for w in words if not w[-1:].isspace() and not w.decode()[-1].isspace()]
        for at in range(0, len(joinable), LEARN):
            part = joinable[at : at + LEARN]
            found = self._together(part)
            if found is None:
                continue
            self._keep(part, Alignment(*found[0], *found[1], self.sizes), np.zeros(len(part), dtype=bool))
        rest = [w for w in words if w not in self.known]
        if rest:
            first, second, wrong = self._one_by_one(rest)
            self._keep(rest, Alignment(*_flat(first), *_flat(second), self.sizes), wrong)

    def _keep(self, words: list[bytes], met: "Alignment", wrong: np.ndarray) -> None:
        keys, cut = met.keys(self.width).astype("<u8"), met.doc_link.tolist()
        (a, cut_a), (b, cut_b) = ((x.astype(kind), y.tolist()) for x, y, kind in zip((met.a, met.b), (met.doc_a, met.doc_b), self.kinds))
        rows = zip(words, wrong.tolist(), np.diff(met.doc_group).tolist(), cut, cut[1:], met.texts(self.names), cut_a, cut_a[1:], cut_b, cut_b[1:])
        for word, bad, n_groups, x, y, shown, p, q, r, s in rows:
            self.known[word] = bad, n_groups, keys[x:y].tobytes(), shown + b";", a[p:q].tobytes(), b[r:s].tobytes()

    def facts(self, words: list[bytes]) -> list[tuple]:
        """For each word: whether it is wrong, its groups, packed id pairs of its links, groups as text, packed ids by both."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known.clear()
            fresh = words
        self._learn(fresh)
        return [self.known[w] for w in words]


def id_kind(table: list[bytes]) -> str:
    """How ids are packed."""
    return "<u2" if len(table) <= 1 << 16 else "<u4"


def pair_width(second: dict) -> int:
    """Bits of the second id in the number of a pair."""
    return max(1, (len(second["bytes"]) - 1).bit_length())


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of blanks that neither tokenizer can join to what stands before them.

    A blank behind a character that is no white space begins a new word for both. Characters are told by their last
    bytes; where those could end a white-space character, the blank is not taken, which only makes a longer word.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[at >= 3]
    a, b, c = data[at - 3], data[at - 2], data[at - 1]
    white = (c <= 0x20) | (c == 0x7F) | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0)))
    white |= (a == 0xE2) & ((b == 0x80) | (b == 0x81))
    white |= ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE1) & (b >= 0x9A) & (b <= 0xA0))
    return at[~white]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter((x for part in lists for x in part), dtype=np.int32, count=int(lengths.sum())), lengths


def _gather(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin and are as long as told, one behind the other."""
    ends = np.cumsum(lengths)
    steps = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    real = lengths > 0
    begins, lengths, ends = begins[real], lengths[real], ends[real]
    if len(begins):
        steps[0] = begins[0]
        steps[ends[:-1]] = begins[1:] - (begins[:-1] + lengths[:-1] - 1)
    return values[np.cumsum(steps)]


class Words:
    """Texts cut into words, and what both tokenizers make of every distinct word.

    Every text stands behind one blank. A word begins where neither tokenizer can join, so a text's ids are those of its
    words. A text with a word that its tokens do not join to is encoded again as one word. ``fits`` says
    which texts have tokens at all: those that are not empty and that both tokenizers join to.
    """

    def __init__(self, coder: Encoder, texts: list[bytes]):
        joined = b"".join(b" " + t for t in texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[cuts(data)] = True
        cut[begins] = True
        self.fits = np.array([bool(t) for t in texts])
        self._look(coder, joined, cut, begins)
        again = np.flatnonzero(self.fits & (self.sums(self.wrong) > 0))
        if len(again):
            for i in again.tolist():
                cut[begins[i] + 1 : begins[i + 1]] = False
            self._look(coder, joined, cut, begins)
            self.fits &= self.sums(self.wrong) == 0

    def _look(self, coder: Encoder, joined: bytes, cut: np.ndarray, begins: np.ndarray) -> None:
        at = np.flatnonzero(cut).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(joined)]).dictionary_encode()
        self.index, self.first = words.indices.to_numpy(), np.searchsorted(at, begins)
        wrong, n_groups, keys, self.shown, *self.ids = zip(*coder.facts(words.dictionary.to_pylist()))
        self.wrong, self.n_groups = np.array(wrong, dtype=np.int64), np.array(n_groups, dtype=np.int64)
        self.n_links = np.array([len(k) >> 3 for k in keys], dtype=np.int64)
        self.keys, self.number = np.unique(np.frombuffer(b"".join(keys), dtype="<u8"), return_inverse=True)

    def sums(self, each: np.ndarray) -> np.ndarray:
        """The sum over each text's words of a number that each distinct word has."""
        return np.add.reduceat(each[self.index], self.first[:-1])

    def joined(self, each: tuple[bytes, ...]) -> list[bytes]:
        """For each text, what its words have, one behind the other; nothing for texts without tokens."""
        column = pa.array(each, pa.large_binary()).take(pa.array(self.index))
        places, data = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1)[self.first].tolist(), memoryview(column.buffers()[2] or b"")
        return [bytes(data[a:b]) if fit else b"" for a, b, fit in zip(places, places[1:], self.fits.tolist())]

    def columns(self) -> dict[str, list]:
        """Packed ids by both, groups, links and the hash of the groups, of each text."""
        shas = [hashlib.sha256(memoryview(t)[:-1]).hexdigest() if t else "" for t in self.joined(self.shown)]
        counted = {"n_groups": self.sums(self.n_groups) * self.fits, "n_links": self.sums(self.n_links) * self.fits}
        return {"a": self.joined(self.ids[0]), "b": self.joined(self.ids[1]), **counted, "groups_sha256": shas}

    def held_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs and how many of the texts hold each."""
        n_words, n_keys = len(self.wrong), max(1, len(self.keys))
        text = np.repeat(np.arange(len(self.fits)), np.diff(self.first))
        held = np.unique((text * n_words + self.index)[self.fits[text]])
        text, word = held // n_words, held % n_words
        begins = np.cumsum(self.n_links) - self.n_links
        links = _gather(self.number, begins[word], self.n_links[word])
        pairs = np.unique(np.repeat(text, self.n_links[word]) * n_keys + links)
        counts = np.bincount(pairs % n_keys, minlength=len(self.keys))
        return self.keys[counts > 0], counts[counts > 0]


# ---- alignment


class Alignment:
    """Groups and links of texts (here: words) that are joined: ids of each tokenizer and how many each text has."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        end_a, end_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
        total = int(end_a[-1]) if len(a) else 0
        marks = np.zeros(total + 1, dtype=np.uint8)
        marks[end_a] = 1
        marks[end_b] |= 2
        ends = np.flatnonzero(marks)
        kind = marks[ends]
        # a stretch between two ends lies in one token of each kind, and every overlapping pair has one stretch
        self.link_a = np.cumsum(kind & 1) - (kind & 1)
        self.link_b = np.cumsum(kind >> 1) - (kind >> 1)
        self.common = ends[kind == 3]
        self.group_a, self.group_b = np.searchsorted(end_a, self.common) + 1, np.searchsorted(end_b, self.common) + 1
        self.doc_a, self.doc_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        doc_end = np.concatenate([[0], end_a])[self.doc_a]
        self.doc_link = np.searchsorted(ends, doc_end, side="right")
        self.doc_group = np.searchsorted(self.common, doc_end, side="right")
        self.doc_link[0] = self.doc_group[0] = 0

    def keys(self, width: int) -> np.ndarray:
        """Each link's id pair as one number."""
        return (self.a[self.link_a].astype(np.uint64) << np.uint64(width)) | self.b[self.link_b].astype(np.uint64)

    def texts(self, names: pa.Array) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text; ``names`` has every id four times, before , | ; and nothing."""
        n_a, n_b = len(self.a), len(self.b)
        last_a, last_b = np.zeros(n_a, dtype=bool), np.zeros(n_b, dtype=bool)
        last_a[self.group_a - 1] = True
        last_b[self.group_b - 1] = True
        closing = np.zeros(n_b, dtype=bool)
        closing[self.doc_b[1:][self.n_b > 0] - 1] = True
        before_a = np.concatenate([[0], self.group_b])[np.cumsum(last_a) - last_a]  # ids of the other kind that come first
        upto_b = self.group_a[np.cumsum(last_b) - last_b] if n_b else np.zeros(0, dtype=np.int64)
        at_a, at_b = np.arange(n_a) + before_a, np.arange(n_b) + upto_b
        which = np.empty(n_a + n_b, dtype=np.int64)
        which[at_a] = 4 * self.a.astype(np.int64) + last_a
        which[at_b] = 4 * self.b.astype(np.int64) + 2 * last_b + closing  # the last group of a text has no end mark
        shown = names.take(pa.array(which))
        data = memoryview(shown.buffers()[2] or b"")
        cut = np.frombuffer(shown.buffers()[1], dtype=np.int64, count=len(shown) + 1)[self.doc_a + self.doc_b].tolist()
        return [bytes(data[a:b]) for a, b in zip(cut, cut[1:])]


# ---- minimal perfect hash


def _slot(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix64(keys ^ seed) % np.uint64(cells)).astype(np.int64)


class PerfectHash:
    """Numbers n distinct keys 0 to n - 1: on each level a key that has its cell alone stays, the others go on.

    The number of a key is the rank of its cell among all set cells; about three bits for each key.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.concatenate([[0], np.cumsum([int(np.bitwise_count(x).sum()) for x in levels])])
        self.ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(x).astype(np.int64))]) for x in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels = []
        while len(keys):
            words = max(1, math.ceil(GAMMA * len(keys) / 64))
            at = _slot(keys, len(levels), 64 * words)
            hits = np.bincount(at, minlength=64 * words)
            levels.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            keys = keys[hits[at] > 1]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; keys that were never given get any number or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            at = _slot(keys[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))).astype(np.int64)
            out[left[here]] = self.base[level] + self.ranks[level][at[here] >> 6] + below
            left = left[~here]
        return out

    def pack(self) -> bytes:
        return b"".join([np.array([len(self.levels), *map(len, self.levels)], dtype="<u8").tobytes(), *[x.tobytes() for x in self.levels]])

    @classmethod
    def unpack(cls, data: bytes) -> "PerfectHash":
        n = int(np.frombuffer(data, "<u8", 1)[0])
        lengths = np.frombuffer(data, "<u8", n, 8).astype(int).tolist()
        cut = np.cumsum([8 + 8 * n, *[8 * x for x in lengths]]).tolist()
        return cls([np.frombuffer(data, "<u8", x, at) for at, x in zip(cut, lengths)])


# ---- the passes


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    rows = max(map(len, columns.values()))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * rows), type=f.type) for f in schema], schema=schema)


def _slice_of(keys: np.ndarray, width: int, n: int) -> np.ndarray:
    return (mix64(keys >> np.uint64(width)) % np.uint64(n)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], coder: Encoder):
    """Documents by blocks of bounded size: the block's rows and their words."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            texts = [t.as_py() or b"" for t in part.column("text").cast(pa.large_string()).cast(pa.large_binary())]
            if texts:
                yield part, Words(coder, texts)


def _slice_rows(keys: np.ndarray, width: int, n: int, **more: np.ndarray) -> dict[str, list]:
    """Columns of one row for each slice that the keys have: place, packed keys and whatever goes with them."""
    place = _slice_of(keys, width, n)
    order = np.argsort(place, kind="stable")
    cut = np.flatnonzero(np.diff(place[order], prepend=-1, append=n)).tolist()
    out = {"place": place[order][cut[:-1]].tolist()}
    for name, values in {"keys": keys, **more}.items():
        values = values[order]
        out[name] = [values[x:y].tobytes() for x, y in zip(cut, cut[1:])]
    return out


PAIRS = [("block", T.LongType()), ("place", T.IntegerType()), ("keys", T.BinaryType()), ("counts", T.BinaryType())]
ENCODED = [("a", T.BinaryType()), ("b", T.BinaryType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]


def encoded(docs: DataFrame, first: dict, second: dict, id_col: str = "doc_id", text_col: str = "text", n_slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """Documents with their packed ids, and the distinct id pairs of every block of documents with how many of them hold each.

    Both come from one pass over the texts and are written; a block's rows of both kinds have its number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType), *[T.StructField(n, t) for n, t in PAIRS + ENCODED]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, block = Encoder(first, second), TaskContext.get().partitionId() << 32
        for part, words in _blocks(batches, coder):
            block += 1
            kinds = arrow.set(0, part.schema.field("id"))
            yield _batch(kinds, id=part.column("id"), block=[block] * part.num_rows, **words.columns())
            keys, counts = words.held_links()
            if len(keys):
                rows = _slice_rows(keys, coder.width, n_slices, counts=counts.astype("<u4"))
                yield _batch(kinds, block=[block] * len(rows["place"]), **rows)

    path = scratch_path(docs.sparkSession, "encoded")
    kept.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    both = docs.sparkSession.read.schema(schema).parquet(path)
    return both.where("place IS NULL").select("id", "block", *[n for n, _ in ENCODED]), both.where("place IS NOT NULL").select(*[n for n, _ in PAIRS])


def _head(table: pa.Table) -> dict:
    return {n: table.column(n).slice(0, 1) for n in ("place", "grp")}


def _values(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=kind) for v in column]


def _tree(rows: DataFrame, merge, schema: str, groups: int) -> DataFrame:
    """Rows of (place, grp, ...) merged, then ``TREE`` groups at a time until each place has one."""
    rows = rows.groupBy("place", "grp").applyInArrow(merge, schema)
    while groups > 1:
        groups = math.ceil(groups / TREE)
        rows = rows.withColumn("grp", F.floor(F.col("grp") / TREE).cast("long")).groupBy("place", "grp").applyInArrow(merge, schema)
    return rows


def _at_groups(tables: DataFrame, groups: int) -> DataFrame:
    """The table of each slice once for every group of blocks."""
    return tables.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))


def pair_counts(pairs: DataFrame, groups: int, width: int) -> DataFrame:
    """Per slice: ``place, hash, held, counts, best`` in the order of a minimal perfect hash.

    ``held`` are the keys, ``counts`` how many documents hold each, ``best`` whether no pair of the same first id has more.
    """

    def union(table: pa.Table) -> pa.Table:
        return pa.table({**_head(table), "keys": pa.array([np.unique(np.concatenate(_values(table.column("keys"), "<u8"))).tobytes()], pa.binary())})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], []
            for keys in _values(batch.column("keys"), "<u8"):
                made.append(PerfectHash.of(keys))
                ordered = np.empty_like(keys)
                ordered[made[-1].find(keys)] = keys
                held.append(ordered.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array([m.pack() for m in made], pa.binary()), pa.array(held, pa.binary())], names=["place", "hash", "held"])

    known = _tree(pairs.select("place", "grp", "keys"), union, "place int, grp long, keys binary", groups)
    hashed = write_through(known.mapInArrow(number, "place int, hash binary, held binary"), "pair_hash")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return VECTORS.empty_table()
        table = PairTable.of(right, 0)
        vector = np.zeros(len(table.held), dtype=np.int64)
        for keys, counts in zip(_values(left.column("keys"), "<u8"), _values(left.column("counts"), "<u4")):
            vector[table.places(keys)] += counts
        return pa.table({**_head(left), "counts": pa.array([vector.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        return pa.table({**_head(table), "counts": pa.array([sum(_values(table.column("counts"), "<i8")).tobytes()], pa.binary())})

    schema = "place int, grp long, counts binary"
    vectors = pairs.groupBy("place", "grp").cogroup(_at_groups(hashed, groups).groupBy("place", "grp")).applyInArrow(count, schema)
    total = _tree(vectors, add, schema, groups).select(F.col("place").alias("at"), "counts")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for held, counts in zip(_values(batch.column("held"), "<u8"), _values(batch.column("counts"), "<i8")):
                ids, at = np.unique(held >> np.uint64(width), return_inverse=True)
                most = np.zeros(len(ids), dtype=np.int64)
                np.maximum.at(most, at, counts)
                flags.append((counts == most[at]).astype(np.uint8).tobytes())
            yield batch.append_column("best", pa.array(flags, pa.binary()))

    joined = hashed.join(total, F.col("place") == F.col("at")).select("place", "hash", "held", "counts")
    return write_through(joined.mapInArrow(best, "place int, hash binary, held binary, counts binary, best binary"), "pair_counts")


VECTORS = pa.schema([("place", pa.int32()), ("grp", pa.int64()), ("counts", pa.binary())])


class PairTable:
    """One slice's pairs behind their perfect hash."""

    def __init__(self, made: bytes, held: bytes, counts: bytes = b"", best: bytes = b""):
        self.made, self.held = PerfectHash.unpack(made), np.frombuffer(held, "<u8")
        self.counts, self.best = np.frombuffer(counts, "<i8"), np.frombuffer(best, np.uint8)

    @classmethod
    def of(cls, table: pa.Table, row: int) -> "PairTable":
        return cls(*[table.column(n)[row].as_py() for n in ("hash", "held", "counts", "best") if n in table.column_names])

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands; the key stored there must be the one looked for."""
        at = self.made.find(keys)
        if (at < 0).any() or not (self.held[at] == keys).all():
            raise KeyError("an id pair was never counted")
        return at


def _grouped(pairs: DataFrame, fan_in: int) -> tuple[DataFrame, int]:
    groups = max(1, math.ceil(pairs.select("block").distinct().count() / fan_in))
    return pairs.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups))), groups


DIGEST = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def link_digest(
    docs: DataFrame,
    first: str = BYTE_BPE,
    second: str = PIECE_BPE,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slices: int = SLICES,
    fan_in: int = FAN_IN,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: tokens of both, groups, links, links of the best count, sum of counts, hash of the groups.

    A text is encoded behind one blank. Null and empty texts, and texts that the tokens do not join to, have no
    tokens: zeros and an empty hash, and they count for no pair. Every row is a document, repeated rows and ids too. Ties for
    the best count are all best. Other columns are not read; an empty table gives an empty one.

    The second pass reads the pair tables from a broadcast if they take ``broadcast_bytes`` at most; else blocks of documents
    meet the counts of their own pairs by shuffle. Both give the same rows.
    """
    a, b = load_byte_level(first), load_pieces(second)
    sizes = tuple(np.array([len(x) for x in v["bytes"]], dtype=np.int64) for v in (a, b))
    kinds, width = (id_kind(a["bytes"]), id_kind(b["bytes"])), pair_width(b)
    written, pairs = encoded(docs, a, b, id_col, text_col, n_slices)
    pairs, groups = _grouped(pairs, fan_in)
    tables = pair_counts(pairs, groups, width)
    out = T.StructType([written.schema["id"], *[T.StructField(n, T.LongType()) for n in DIGEST[:-1]], T.StructField(DIGEST[-1], T.StringType())])

    def digests(batch: pa.RecordBatch, look_up) -> pa.RecordBatch:
        """The rows of some documents, aligned again; ``look_up`` gives counts and best marks of distinct pairs."""
        ids, lengths = zip(*[_unpack(batch.column(c), kind) for c, kind in zip("ab", kinds)])
        met = Alignment(ids[0], lengths[0], ids[1], lengths[1], sizes)
        keys, number = np.unique(met.keys(width), return_inverse=True)
        counts, best = look_up(keys)
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[number])])[met.doc_link]) for x in (best.astype(np.int64), counts)]
        columns = [*map(pa.array, lengths), batch.column("n_groups"), batch.column("n_links"), *map(pa.array, sums), batch.column("groups_sha256")]
        return pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *DIGEST])

    size = tables.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in ("hash", "held", "counts", "best")), F.lit(0).cast("long"))), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast({r["place"]: tuple(map(bytes, r[1:])) for r in tables.collect()})

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {place: PairTable(*packed) for place, packed in shared.value.items()}

            def look_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                place = _slice_of(keys, width, n_slices)
                counts, best = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.uint8)
                for p in np.unique(place).tolist():
                    here = np.flatnonzero(place == p)
                    at = known[p].places(keys[here])
                    counts[here], best[here] = known[p].counts[at], known[p].best[at]
                return counts, best

            for batch in batches:
                for part in slices(batch, "a", SLICE_BYTES):
                    yield digests(part, look_up)

        return written.mapInArrow(by_broadcast, out).withColumnRenamed("id", id_col)

    asked = pairs.select("place", "grp", "block", "keys")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, best = [], []
        for keys in _values(left.column("keys"), "<u8"):
            table = PairTable.of(right, 0) if not counts else table
            at = table.places(keys)
            counts.append(table.counts[at].tobytes())
            best.append(table.best[at].tobytes())
        return pa.table({"b": left.column("block"), "k": left.column("keys"), "counts": pa.array(counts, pa.binary()), "best": pa.array(best, pa.binary())})

    answers = asked.groupBy("place", "grp").cogroup(_at_groups(tables, groups).groupBy("place", "grp")).applyInArrow(answer, "b long, k binary, counts binary, best binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts, best = (np.concatenate([np.zeros(0, kind), *_values(right.column(c), kind)]) for c, kind in (("k", "<u8"), ("counts", "<i8"), ("best", np.uint8)))
        order = np.argsort(keys)

        def look_up(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = order[np.searchsorted(keys, wanted, sorter=order)] if len(wanted) else np.zeros(0, np.int64)
            if not (keys[at] == wanted).all():
                raise KeyError("an id pair was never counted")
            return counts[at], best[at]

        return pa.Table.from_batches([digests(batch, look_up) for batch in left.combine_chunks().to_batches()])

    return written.groupBy("block").cogroup(answers.groupBy("b")).applyInArrow(finish, out).withColumnRenamed("id", id_col)


def _unpack(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, joined, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).astype(np.int64), np.array([len(r) for r in rows], dtype=np.int64) // np.dtype(kind).itemsize


def pair_table(docs: DataFrame, first: str = BYTE_BPE, second: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text", n_slices: int = SLICES, fan_in: int = FAN_IN) -> DataFrame:
    """``a, b, n_docs, best``: every linked id pair, how many documents hold it, and whether no pair of ``a`` has more."""
    a, b = load_byte_level(first), load_pieces(second)
    width = pair_width(b)
    tables = pair_counts(*_grouped(encoded(docs, a, b, id_col, text_col, n_slices)[1], fan_in), width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, counts, best in zip(*[_values(batch.column(n), k) for n, k in (("held", "<u8"), ("counts", "<i8"), ("best", np.uint8))]):
                ids = [held >> np.uint64(width), held & np.uint64((1 << width) - 1)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in ids], pa.array(counts), pa.array(best.astype(bool))], names=["a", "b", "n_docs", "best"])

    return tables.mapInArrow(rows, "a int, b int, n_docs long, best boolean")
