"""Repeated strings of 100 bytes, against every string one by one."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolworks.llm import suffixes
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows):
    """Rows in order of (id, text); equal ids and texts are one document."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, text or ""] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(frame, rows, **options):
    got = suffixes.cut_repeats(frame, **options).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    for r in got:
        answers = {want[r.doc_id, t] for t in texts[r.doc_id]}
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) in answers, r.doc_id


def made(seed, n=120):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(["ab", "abc", "x", "yé", "zzz", "q" * 9, "lorem", "ipsum"]) + str(rng.randrange(40)) for _ in range(k))
    shared = [say(rng.randrange(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [say(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared)[rng.randrange(9) :])
        rows.append((i, " ".join(parts)))
    base = rows[0][1] + say(80)
    for k in range(n, n + 20):
        words = base.split()
        words[rng.randrange(len(words))] = "edit"
        rows.append((k, " ".join(words)))
    return rows


EDGES = [
    (500, None), (501, ""), (502, "a" * 99), (503, "a" * 100), (504, "a" * 101), (505, "a" * 5000), (506, "ab" * 400), (None, "ab" * 200 + "tail" * 40),
    (None, "ab" * 200 + "tail" * 40), (507, "dup" * 50), (508, "dup" * 50), (508, "dup" * 50), (509, "é" * 80), (510, "xé" + "é" * 80),
    (511, "0123456789" * 9 + "012345678"), (512, "0123456789" * 10),
]


@pytest.mark.parametrize("hot", [200, 2])
def test_made_documents(docs_of, hot):
    rows = made(1) + EDGES
    check(docs_of(rows).withColumns({"tag": F.lit("t"), "raw": F.lit(1)}), rows, hot_entries=hot)


def test_small_parts_and_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 700)
    monkeypatch.setattr(suffixes, "WINDOWS", 300)
    rows = made(2, 60) + EDGES
    check(docs_of(rows), rows)


def test_no_rows(docs_of):
    assert suffixes.cut_repeats(docs_of([])).count() == 0


def test_equal_strings_sorts_exactly():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1400] = data[:400]
    data[2000:2300] = data[50:350]
    at, group = rng.integers(0, 3900, 3000), rng.integers(0, 2, 3000)
    at = np.concatenate([at, np.arange(1000, 1300), np.arange(0, 300)])
    group = np.concatenate([group, np.zeros(600, np.int64)])
    who, number = suffixes.equal_strings(data, at, group)
    named = {}
    for k, (a, g) in enumerate(zip(at, group)):
        named.setdefault((g, data[a : a + 100].tobytes()), set()).add(k)
    want = {frozenset(v) for v in named.values() if len(v) > 1}
    got = {}
    for w, n in zip(who.tolist(), number.tolist()):
        got.setdefault(n, set()).add(w)
    assert {frozenset(v) for v in got.values()} == want


def test_the_table(spark, corpus):
    rows = [(d["doc_id"], d["text"]) for d in corpus]
    want = brute(rows)
    got = QUERIES["op5_suffix_dedup"](spark, FOLDER).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, texts[r.doc_id] or ""]
