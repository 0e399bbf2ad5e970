"""Conversation repair against a search over all edits, and against a plain run of the contract."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.llm import conversations as conv
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if hit == 0:
            continue
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        out += [(c, t, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for r, x in rows:
        words = WORD.findall(x)
        out.append("b" if not words else "d" if (r, x) in seen else "k" if words[-1] in ".!?" else "t")
        seen.add((r, x))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) and its turns, by a search over the strings themselves."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, tail, made = heapq.heappop(heap)
        if at == len(rows) and tail in ("", "a"):
            return cost, audit, made
        if (at, tail) in done:
            continue
        done.add((at, tail))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]

        def go(price, letter, role, text, step):
            heapq.heappush(heap, (cost + price, audit + letter, at + step, role[:1], (*made, (role, text))))  # noqa: B023

        for role in ("user", "assistant"):
            if role[0] in fits:
                go(3, "I", role, "", 0)
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, tail, made))
            if faults[at] not in "bd":
                extra = 3 * (faults[at] == "t")
                if role[:1] and role[:1] in fits:
                    go(extra, "K", role, text, 1)
                for other in ("user", "assistant"):
                    if other[0] in fits:
                        go(3 + extra, "R", other, text, 1)
    raise AssertionError


def brute(rows, hurt=True):
    names = {r[0] for r in rows}
    rows = damaged(rows) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for name in names:
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        said = [(r, x) for _, _, r, x in mine]
        turns = [t for _, t, _, _ in mine if t is not None]
        faults = faults_of(said)
        cost, audit, made = cheapest(said, faults)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        body = "\n".join(f"{r}:{x}" for r, x in made)
        out.append((name, gaps, *[faults.count(f) for f in "bdt"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest()))
    return out


def made_rows(seed, conversations=40, longest=30):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", ""]) if rng.random() < 0.4 else "ua"[t % 2].replace("u", "user") if t % 2 == 0 else "assistant"
            text = rng.choice(["Yes.", "no", "Why? ", " \n", f"text {rng.randrange(6)}.", f"cut {rng.randrange(6)}", "so!\t"])
            rows.append((c, t if rng.random() < 0.9 else t + rng.randrange(3), role, text))
    return rows


def sort(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed,open_rows", [(1, 8192), (2, 3)])
def test_against_search(spark, seed, open_rows, monkeypatch):
    rows = made_rows(seed)
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    assert sort(conv.repair_digest(conv.damage(turns), open_rows).collect()) == sort(brute(rows))


def test_one_long_conversation_over_many_tasks(spark):
    """A hot conversation lies in every range partition; chunks of a few rows; many equal rows."""
    rng = random.Random(4)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "assistant"]), rng.choice(["Yes.", f"line {t}.", f"cut {rng.randrange(300)}"])) for t in range(1500)]
    rows += [(7, 5, "user", "again.")] * 300 + made_rows(9, 10)
    turns = spark.createDataFrame(rows, TURNS).repartition(6)
    assert sort(conv.repair_digest(conv.damage(turns), open_rows=50).collect()) == sort(brute(rows))
    got = conv.repaired_turns(turns.where("conv_id = 7"), open_rows=50).orderBy("piece", "blk", "place").collect()
    body = "\n".join(f"{r.role}:{r.text}" for r in got)
    assert hashlib.sha256(body.encode()).hexdigest() == next(r[-1] for r in brute([r for r in rows if r[0] == 7], hurt=False))


def test_edge_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "assistant", "b."), (2, 0, None, "x."), (3, 0, "", "x."), (4, 0, "user", None)]
    rows += [(5, t, "user", "Same.") for t in range(9)] + [(6, 2, "user", "É…")] * 3 + [(8, 0, "user", "long " * 400_000), (8, 1, "assistant", "b.")]
    rows += [(9, 2**62, "user", "a."), (9, -(2**61), "assistant", "b.")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit(1)).withColumn("gaps", F.lit("x")).withColumn("open", F.lit(True))
    assert sort(conv.repair_digest(conv.damage(turns)).collect()) == sort(brute(rows))
    assert conv.repair_digest(conv.damage(turns.limit(0))).collect() == []


def test_all_rows_dropped(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = conv.repair_digest(conv.damage(spark.createDataFrame([(c, 0, "user", "a.") for c in gone], TURNS))).collect()
    assert sort(got) == sort([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone])


def test_runs_equal_single_steps():
    """Binary powers of a run and row by row transitions give the same costs and letters."""
    rng = random.Random(0)
    for _ in range(60):
        marks = "".join(rng.choice("suaxSUAXd") * rng.choice([1, 1, 2, 7, 33]) for _ in range(rng.randrange(12)))
        v = conv.END
        for mark in reversed(marks):
            v = conv.apply(conv.power(mark, 0), v)
        letters, tail = conv.solve(marks)
        assert conv.apply(conv.matrix(marks), conv.END) == v
        assert conv.cost_of(letters, marks) + 3 * len(tail) == v[0]


def test_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sort(QUERIES["op13_conversation_repair"](spark, FOLDER).collect()) == sort(brute(rows))
