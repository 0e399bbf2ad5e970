"""Near duplicates against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoolworks.llm import components, jaccard, sieve
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows):
    """Set size and least reachable id of each row, by index of the row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in held[x]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for x in s:
            held[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def made(seed, n=150):
    rng = random.Random(seed)
    say = lambda k, v=60: [f"w{rng.randrange(v)}" for _ in range(k)]
    bases = [say(rng.choice([5, 8, 30, 100, 300])) for _ in range(12)]
    line = say(30)
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = say(1)
        if rng.random() < 0.3:
            words = line + words
        rows.append((i * 7 % n, " ".join(words) if i % 5 else " ".join(words).upper() + "\n"))
    return rows + [(1000 + i, " ".join(say(rng.randrange(7), 3))) for i in range(60)]


EDGES = [(None, "alone one two three four five six"), (2000, None), (2001, ""), (2002, " \n\t"), (2003, "A b"), (2004, "a  B "), (2005, "a b c"), (2003, "A b"), (2006, "É b"), (2007, "é b"), (2008, "lone " * 3000)]


def compare(frame, rows, **options):
    got = sorted((tuple(r) for r in jaccard.near_duplicates(frame, **options).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("seed,tile", [(1, 20_000), (2, 20_000), (3, 4)])
def test_made_documents(docs_of, seed, tile):
    rows = made(seed) + EDGES
    compare(docs_of(rows).withColumns({"id": F.lit("x"), "n": F.lit(1), "tag": F.lit(2)}), rows, tile=tile)


def test_no_rows_and_no_links(docs_of):
    assert jaccard.near_duplicates(docs_of([])).count() == 0
    compare(docs_of([(1, "a b c d e f"), (2, "g h i j k l")]), [(1, "a b c d e f"), (2, "g h i j k l")])


def test_one_document_of_each_group_stays(docs_of):
    rows = made(4) + EDGES
    docs = docs_of(rows).withColumn("gone_id", F.lit(1))
    kept = jaccard.keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d, _, c in brute(rows) if d == c)
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    same_id = [(7, " ".join(words)), (7, " ".join([*words, *"abcdefghijkl"])), (7, " ".join([*words, *"abcdefghijk"])), (9, " ".join([*words, *"abcdefghij"]))]
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first_of_groups(docs_of(same_id)).collect()]
    assert len(kept) == 2 and {d for d, _ in kept} == {7} and same_id[0] in kept


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 99, 20).astype(np.uint64)]))
        if len(b) == 0:
            continue
        both = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(jaccard.signature(s), np.uint64)[None, :] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        assert linked == (both >= jaccard.needed(len(a), len(b)))
        assert jaccard._may_link(jaccard._fold(x, width)[0], len(a), jaccard._fold(y, width), np.array([len(b)]))[0] or not linked
        if linked:
            assert set(a[: jaccard.prefix_length(len(a))]) & set(b[: jaccard.prefix_length(len(b))])
            x, y = (s[: jaccard.prefix_length(len(s)) + jaccard.more_keys(len(s))] for s in (a, b))
            assert len(np.intersect1d(x, y)) >= max(jaccard.least_shared(len(a)), jaccard.least_shared(len(b)))


def test_linked_sets_meet_at_their_first_shared_key():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.permutation(2000).astype(np.uint64)
        a = np.sort(pool[: rng.integers(1, 400)])
        b = np.sort(np.concatenate([a[rng.random(len(a)) < rng.choice([0.85, 0.95, 1.0])], pool[400 : 400 + rng.integers(0, 1 + len(a) // 9)]]))
        if len(b) == 0 or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        lists = [s[: jaccard.prefix_length(len(s)) + jaccard.more_keys(len(s))] for s in (a, b)]
        keys, n = np.concatenate(lists), np.array([len(a), len(b)])
        row = np.repeat([0, 1], [len(s) for s in lists])
        place = np.concatenate([np.arange(len(s)) for s in lists])
        live = np.isin(keys, np.intersect1d(*lists)) | (rng.random(len(keys)) < rng.choice([0, 0.3]))  # others may pass the filter
        chosen = jaccard.first_shared(live, row, place, n)
        shared = np.intersect1d(*lists)
        assert shared[0] in keys[chosen & (row == 0)] and shared[0] in keys[chosen & (row == 1)]
        assert (chosen <= live).all()


@pytest.mark.parametrize("slice_bits", [0, 3])
def test_repeated_keys_with_and_without_names(spark, slice_bits):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    calls, held = [], defaultdict(set)
    for call in range(4):
        own, who, lone = [], [], []
        for holder in range(60):
            alone = holder % 3 > 0
            name = 1000 * call + holder if alone else holder  # the others come in every call
            pick = np.random.default_rng(name).choice(keys, 30, replace=False)
            for k in pick:
                held[int(k)].add(name)
            own.append(pick)
            who += [name] * 30
            lone += [alone] * 30
        calls.append(sieve.pack(np.concatenate(own), np.array(who, np.uint64), slice_bits, np.array(lone)))
    rows = [(s, bytes(d)) for c in calls for s, d in zip(c.column("slice").to_pylist(), c.column("data").to_pylist())]
    marks = sieve.repeated(spark.createDataFrame(rows, sieve.PACKED), slice_bits)
    several = np.array([k for k, names in held.items() if len(names) > 1], np.uint64)
    single = np.array([k for k, names in held.items() if len(names) == 1], np.uint64)
    assert len(several) > 100 and len(single) > 100
    assert sieve.may_repeat(marks, several).all() and sieve.may_repeat(marks, single).mean() < 0.01


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 120)] + [(500, 500 + i) for i in range(1, 60)] + [(700, 701), (701, 700), (800, 800)]
    rows = components.components(spark.createDataFrame(links, "high long, low long")).collect()
    got = {r.node: r.root for r in rows}
    assert got == {i: 0 for i in range(121)} | {500 + i: 500 for i in range(60)} | {700: 700, 701: 700}
    assert components.components(spark.createDataFrame([], "high long, low long")).count() == 0


def test_components_take_no_rounds_for_links_of_one_task_and_none_to_confirm(spark, monkeypatch):
    written = []
    keep = components.write_through
    monkeypatch.setattr(components, "write_through", lambda df, name: written.append(name) or keep(df, name))
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "high long, low long")
    expected = {i: 0 for i in range(301)}
    assert {r.node: r.root for r in components.components(chain).collect()} == expected
    assert written == ["links"]
    # links of several blocks still need rounds, and end on the same roots
    monkeypatch.setattr(components, "BLOCK", 7)
    blocks = [components._stars(np.arange(a + 1, a + 8), np.arange(a, a + 7)).to_pylist() for a in range(0, 294, 7)]
    spread = spark.createDataFrame([(r["high"], r["low"]) for b in blocks for r in b] + [(i + 1, i) for i in range(294, 300)], "high long, low long")
    monkeypatch.setattr(components, "_block_stars", lambda batches: batches)
    assert {r.node: r.root for r in components.components(spread).collect()} == expected
    assert len(written) > 2


def test_blocks_of_links_are_joined_to_stars(monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 3)
    links = pa.RecordBatch.from_pydict({"high": pa.array([5, 9, 4, -1, 7]), "low": pa.array([4, 5, -3, -8, 7])})
    out = [r for b in components._block_stars(iter([links.slice(0, 2), links.slice(2, 1), links.slice(3)])) for r in b.to_pylist()]
    assert out == [{"high": h, "low": low} for h, low in ((4, -3), (5, -3), (9, -3), (-1, -8))]
    assert list(components._block_stars(iter([links.slice(0, 0)])))[0].num_rows == 0 and not list(components._block_stars(iter([])))


def test_the_table(spark, corpus):
    rows = [(d["doc_id"], d["text"]) for d in corpus]
    got = sorted(tuple(r) for r in QUERIES["op6_jaccard_join"](spark, FOLDER).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute(rows))


def test_what_moves_grows_as_the_input():
    # a set goes to a bundle once, with all its tiles
    tiles = np.array([7 << 32, 9 << 32, (7 << 32) + 5, 1 << 32], dtype=np.uint64)
    rows, lists = jaccard._tile_lists(np.array([4, 2, 4, 2]), tiles)
    assert rows.tolist() == [2, 4] and [np.frombuffer(x, np.uint32).tolist() for x in lists.to_pylist()] == [[9, 1], [7, 7]]
    # the filter has two cells a key, within bounds
    assert [jaccard.filter_bits(n) for n in (0, 30_000_000, 2**26, 2**40)] == [26, 26, 27, 30]
