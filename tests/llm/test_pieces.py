"""Sampled segmentations: exact round trips, the sampling law, reproducibility."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from spoolworks.llm import pieces
from spoolworks.llm.arrow import slices
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
ODD = [
    "", "a", " ", "  two  blanks ", "▁own mark ▁▁ x", "tab\tand\nline\r\n", "😀 emoji 👩‍👩‍👧 ñ é ́", "x" * 5000, " " * 700, "日本語のテキスト", "\x00\x01 zero",
    "The quick brown fox.", "▁", "a▁", "▁ ▁a", "word " * 300,
]


@pytest.fixture(scope="module")
def model():
    return pieces.load_model()


def test_round_trip_of_odd_texts(model):
    keys = np.arange(len(ODD), dtype=np.uint64)
    ids, ends = pieces.encode(ODD, keys, model)
    assert [b.decode() for b in pieces.decode(ids, ends, model)] == ODD
    # the library decodes the pieces to the same texts
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    cuts = [0, *ends.tolist()]
    for text, a, b in zip(ODD, cuts, cuts[1:]):
        if "▁" not in text and "\x00" not in text:
            assert processor.decode(ids[a:b].tolist()) == text


def segmentations(text, table):
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in table:
            i, w = table[text[:n]]
            out += [((i, *rest), w + more) for rest, more in segmentations(text[n:], table)]
    return out


def test_samples_follow_the_lattice(model):
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    table = {processor.id_to_piece(int(i)): (int(i), w) for i, w in zip(model["ids"], model["weights"])}
    ways = segmentations("▁there", table)
    weights = np.exp([w for _, w in ways])
    want = dict(zip([s for s, _ in ways], weights / weights.sum()))
    n = 40_000
    ids, ends = pieces.encode(["there"] * n, np.arange(n, dtype=np.uint64), model)
    cuts = [0, *ends.tolist()]
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:]))
    assert set(got) <= set(want)
    for s, p in want.items():
        assert abs(got[s] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_samples_depend_on_key_place_and_seed_alone(model):
    texts, keys = ["one two one two there", "other", "one two one two there"], np.array([5, 6, 7], np.uint64)
    ids, ends = pieces.encode(texts, keys, model)
    alone = [pieces.encode([t], keys[i : i + 1], model)[0].tolist() for i, t in enumerate(texts)]
    cuts = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == alone
    long = "there is a place where all of the words are sampled " * 20
    draws = {tuple(pieces.encode([long], np.array([k], np.uint64), model, seed)[0].tolist()) for k in (1, 2) for seed in (0, 1)}
    assert len(draws) == 4


def test_documents(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, ODD[3]), (99, "é" * 200_000)]
    docs = docs_of(rows).withColumn("row_key", F.lit("own"))
    tokens = pieces.encode_documents(docs)
    back = pieces.decode_tokens(tokens.drop("text"))
    assert tokens.columns == [*docs.columns, "tokens"]
    got = [(r.doc_id, r.text, r.row_key) for r in back.collect()]
    assert sorted(got, key=repr) == sorted([(i, t or "", "own") for i, t in rows], key=repr)
    once = {(r.doc_id, r.text): r.tokens for r in tokens.collect()}
    again = {(r.doc_id, r.text): r.tokens for r in pieces.encode_documents(docs.repartition(7)).collect()}
    assert once == again
    assert pieces.encode_documents(docs_of([])).count() == 0 and pieces.encoded_digest(docs_of([])).count() == 0


def test_the_table_is_lossless(spark, corpus):
    rows = QUERIES["op3_sentencepiece"](spark, FOLDER).collect()
    assert len(rows) == len(corpus) and all(r.lossless for r in rows)


def test_a_long_run_is_one_lattice(model):
    """1,000 characters without a blank: the sums are those of all ways over the whole run, and pieces cross every place."""
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    table = {processor.id_to_piece(int(i)): w for i, w in zip(model["ids"], model["weights"])}
    text = ("therestationing日本語where" * 60)[:1000]
    chunks = pieces.Chunks([text, "two words"])
    points = chunks.points[: chunks.sizes[0]]
    _, begin, end, weight, _, offset = pieces._lattice(points, np.array([len(points)]), model)
    start = begin
    got = pieces._forward(len(points) + 1, np.array([0]), begin, end, weight, offset[start] + end - begin)
    run = "▁" + text
    want = [0.0]
    for j in range(1, len(run) + 1):
        ways = [want[i] + table[run[i:j]] for i in range(max(0, j - model["longest"]), j) if run[i:j] in table]
        if run[j - 1] not in table:
            ways.append(want[j - 1] + model["byte_weight"] * len(run[j - 1].encode()))
        want.append(np.logaddexp.reduce(ways))
    assert np.allclose(got, want)
    crossed = set()
    for key in range(40):
        ids, _ = pieces.encode([text], np.array([key], np.uint64), model)
        ends = np.cumsum([len(processor.id_to_piece(int(i))) if not processor.is_byte(int(i)) else 0 for i in ids])
        crossed |= set(range(1001)) - set(ends.tolist())
    inside = {p for a, b in zip(begin.tolist(), end.tolist()) for p in range(a + 1, b)}
    assert crossed - {0} <= inside and len(crossed) > 0.5 * len(inside)


def test_edges_come_by_end_and_every_piece_is_found(model):
    """Edges need no sorting: places go offset by offset, the edges into one by length; a piece alone has an edge over all of it."""
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = sorted((processor.id_to_piece(int(i)) for i in model["ids"]), key=len, reverse=True)
    sizes, n = np.array([len(t) for t in texts]), len(texts)
    points = np.array([ord(t[k]) for k in range(sizes[0]) for t in texts if len(t) > k])
    count, begin, end, weight, piece, offset = pieces._lattice(points, sizes, model)
    assert (np.diff(end) >= 0).all() and count.sum() == len(end) == len(begin) and (count > 0).all()
    length = offset[end] - offset[begin]
    assert (length > 0).all() and (np.diff(length)[np.diff(end) == 0] > 0).all()
    whole = {int(model["ids"][p]) for p in piece[begin < n] if p < len(model["ids"])}
    assert whole == set(model["ids"].tolist())
    assert np.array_equal(weight, model["costs"][piece])
    sums = pieces._forward(n + len(points), np.arange(n), begin, end, weight, offset[end])
    for k in range(0, n, 997):
        one = pieces._lattice(np.array([ord(c) for c in texts[k]]), sizes[k : k + 1], model)
        alone = pieces._forward(sizes[k] + 1, np.array([0]), *one[1:4], one[5][one[2]])
        ends = [k, *(n + np.cumsum([0, *[(sizes > j).sum() for j in range(sizes[k] - 1)]]) + k)]
        assert np.array_equal(sums[ends], alone)


def test_draws_are_those_of_the_sorted_lattice(model):
    """The digest was taken when the edges of all chunks were sorted."""
    ids, ends = pieces.encode([*ODD, "é" * 20000, "\U0010ffff", "ab" * 30000], np.arange(len(ODD) + 3, dtype=np.uint64) * 7, model, 3)
    assert hashlib.sha256(ids.tobytes() + ends.tobytes()).hexdigest()[:16] == "b47c3bfd1cb934fe"


def test_memory_of_a_slice_is_bounded(model):
    """A worker on a batch of many texts, all words of which differ, needs little above the batch."""
    draw = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = ["".join(letters[draw.integers(0, 26, 8)]) + " " + " ".join("".join(w) for w in letters[draw.integers(0, 26, (250, 8))]) for _ in range(1000)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    tracemalloc.start()
    for part in slices(batch, "text", pieces.SLICE_BYTES):
        pieces.encode(part.column("text").to_pylist(), np.arange(part.num_rows, dtype=np.uint64), model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 2 << 20 and peak < 60 << 20
