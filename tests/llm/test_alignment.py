"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoolworks.llm import alignment as al
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows):
    """Digest of each row and counts of pairs, each text encoded whole."""
    first, second = Tokenizer.from_file(al.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=al.PIECE_BPE)
    first.encode_special_tokens = True
    tables = al.load_byte_level()["bytes"], al.load_pieces()["bytes"]
    docs = []
    for d, text in rows:
        text = text or ""
        ids = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        want = (" " + text).encode()
        if not text or any(b"".join(t[i] for i in part) != want for t, part in zip(tables, ids)):
            docs.append((d, [], [], [], []))
            continue
        spans = []
        for table, part in zip(tables, ids):
            at, mine = 0, []
            for i in part:
                mine.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(mine)
        links, j = [], 0
        for s, e, a in spans[0]:
            while j and spans[1][j][0] > s:
                j -= 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links.append((a, spans[1][k][2]))
                k += 1
            j = max(k - 1, 0)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in mine if low <= s < end) for mine in spans) if len(ends) < 400 else None)
            low = end
        if groups and groups[0] is None:
            groups, x, y = [], 0, 0
            for end in ends:
                parts = []
                for mine, at in ((spans[0], x), (spans[1], y)):
                    k = at
                    while k < len(mine) and mine[k][0] < end:
                        k += 1
                    parts.append((",".join(str(i) for _, _, i in mine[at:k]), k))
                x, y = parts[0][1], parts[1][1]
                groups.append(parts[0][0] + "|" + parts[1][0])
        docs.append((d, ids[0], ids[1], links, groups))
    counts = defaultdict(int)
    for _, _, _, links, _ in docs:
        for pair in set(links):
            counts[pair] += 1
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for d, a, b, links, groups in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return out, counts


def sort(rows):
    return sorted(map(tuple, rows), key=repr)


HARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b\n  c\t d\n\n e", "<|endoftext|> is <s> text </s> <unk> <0x41>", "▁", "x ▁ y", "a▁b", "naïve café — “quoted” … end",
    "日本語のテキスト と 中文 文本", "Привет мир, как дела", "א ב ג", "x  y　 z  w\u0085 v​ u᠎ t  s", "\x00 nul \x1c sep \x7f del", "🙂 emoji 👩‍👩‍👧 family", "don't we'll I'm they've 'sup",
    "1234567 12 345", "é combining", "ａｂｃ ﬁ full width", "\r\n dos\r\nlines\r", "tab\tsep  arated", "a" * 300, "。 。  。", "' s 't  're",
]


def made(seed, n=60):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "the", "Ünï", "мир", "語", "▁" if seed == 2 else "é", "'s", "...", "12", " ", " ", "🙂", "\r", "ź", "-"]
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_whole_texts(docs_of, seed):
    rows = [(1000 + i, t) for i, t in enumerate(HARD)] + made(seed)
    want, counts = brute(rows)
    assert sort(al.link_digest(docs_of(rows)).collect()) == sort(want)
    got = al.pair_table(docs_of(rows), fan_in=1).collect()
    assert {(r.a, r.b): r.n_docs for r in got} == dict(counts)


def test_tables_by_shuffle_and_deep_trees(docs_of, monkeypatch):
    """Nothing broadcast, one block to each group, small blocks: the same rows."""
    monkeypatch.setattr(al, "SLICE_BYTES", 200)
    monkeypatch.setattr(al, "TREE", 2)
    rows = [(1000 + i, t) for i, t in enumerate(HARD)] + made(3, 120)
    want, _ = brute(rows)
    assert sort(al.link_digest(docs_of(rows, 7), fan_in=2, n_slices=5, broadcast_bytes=-1).collect()) == sort(want)
    assert sort(al.link_digest(docs_of(rows, 7), fan_in=2, n_slices=5).collect()) == sort(want)


def test_perfect_hash():
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n, dtype=np.uint64))
        made_ = al.PerfectHash.unpack(al.PerfectHash.of(keys).pack())
        assert sorted(made_.find(keys).tolist()) == list(range(len(keys)))
        assert sum(len(x) for x in made_.levels) * 64 <= 8 * max(len(keys), 64)


def test_edge_tables(docs_of, spark):
    assert al.link_digest(docs_of([])).collect() == []
    assert al.link_digest(docs_of([(1, None), (2, "")])).orderBy("doc_id").collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")
    docs = docs_of([(1, "same text here"), (1, "same text here"), (None, "word " * 300_000)])
    for name in ("id", "block", "place", "n_a", "keys", "counts", "grp"):
        docs = docs.withColumn(name, F.lit("x"))
    got = al.link_digest(docs).collect()
    assert len(got) == 3 and len({tuple(r) for r in got if r.doc_id == 1}) == 1
    assert next(r for r in got if r.doc_id is None).n_links >= 300_000


def test_the_table(spark, corpus):
    want, _ = brute([(d["doc_id"], d["text"]) for d in corpus])
    assert sort(QUERIES["op12_token_alignment"](spark, FOLDER).collect()) == sort(want)
