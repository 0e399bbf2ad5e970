"""SimHash near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spoolworks.llm import simhash
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = np.array([brute_print(t) for _, t in rows], dtype=np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4):
            parent[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints.tolist()))]


def sort(rows):
    return sorted(map(tuple, rows), key=repr)


def made(seed, n=250):
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    bases = [say(rng.choice([20, 200, 600])) for _ in range(15)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = say(1)[0]
        rows.append((i * 7 % n, " ".join(words).upper() if i % 4 else "\t".join(words) + "\n"))
    return rows + [(1000 + i, " ".join(say(rng.randrange(6)))) for i in range(30)]


@pytest.mark.parametrize("groups,tile", [(None, 4096), (6, 4096), (8, 4096), (5, 8)])
def test_against_all_pairs(docs_of, groups, tile):
    rows = made(3)
    got = simhash.near_duplicate_components(docs_of(rows), groups=groups, tile=tile).collect()
    assert sort(got) == sort(brute(rows))
    assert len({r[2] for r in got}) < len({r[1] for r in got})


@pytest.mark.parametrize("groups,tile", [(5, 1 << 20), (7, 1 << 20), (5, 50)])
def test_links_of_random_prints(spark, groups, tile):
    """Fingerprints at every small distance from a few centres: the links join what all pairs join."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [int(c) for c in centres]
    for c in centres:
        for flips in (1, 3, 4, 5, 6, 8):
            x = int(c)
            for b in rng.choice(64, flips, replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    prints = np.unique(np.array(prints, dtype=np.uint64))
    fps = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = [(r.high, r.low) for r in simhash.near_links(fps, groups=groups, tile=tile).collect()]
    signed = prints.view(np.int64).tolist()
    want, got = {x: x for x in signed}, {x: x for x in signed}

    def union(root, a, b):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    for i, x in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ x) <= 4):
            union(want, signed[i], signed[int(j)])
    for a, b in links:
        union(got, a, b)

    def parts(root):
        out = {}
        for x in signed:
            r = x
            while root[r] != r:
                r = root[r]
            out.setdefault(r, set()).add(x)
        return sorted(map(sorted, out.values()))

    assert parts(got) == parts(want)


def test_edge_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (7, "É two"), (None, "q")]
    rows.append((8, "long word " * 120_000))
    got = simhash.near_duplicate_components(docs_of(rows)).collect()
    assert sort(got) == sort(brute(rows))
    assert {r[2] for r in got if r[1] == "0" * 16} == {1}


def test_empty_and_clashing(docs_of, spark):
    assert simhash.near_duplicate_components(docs_of([])).collect() == []
    docs = docs_of([(1, "a b c d e"), (2, "a b c d e")])
    for name in ("fp", "least", "root", "node", "cell", "fingerprint", "component_id"):
        docs = docs.withColumn(name, F.lit("x"))
    assert {r.component_id for r in simhash.near_duplicate_components(docs).collect()} == {1}


def test_the_table(spark, corpus):
    want = brute([(d["doc_id"], d["text"]) for d in corpus])
    assert sort(QUERIES["op11_simhash"](spark, FOLDER).collect()) == sort(want)


def test_spark_hashes_alike(spark):
    """The hash is XXH64 with seed 42, as Spark's own."""
    got = spark.createDataFrame([("one two three vier",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == xxhash.xxh64(b"one two three vier", seed=42).intdigest()


def test_more_groups_for_more_rows():
    assert [simhash.groups_for(n) for n in (0, 10**5, 10**7, 10**9, 10**11)] == [5, 5, 6, 7, 9]
