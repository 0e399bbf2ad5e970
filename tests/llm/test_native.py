"""The operators that run as DataFrame and SQL functions alone, against plain Python."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spoolworks.llm import exact, mixing, pii, sharding
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    spans = [
        (m.start(), order, m.end(), kind)
        for order, (kind, (pattern, test)) in enumerate(tests.items())
        for m in re.finditer(pattern, text or "")
        if test(m.group())
    ]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


TRICKY = [
    None,
    "",
    "a@b.c.d@e.f g%h@i-j.k a@b.com.x_y@z.com @x.y a@b a@.b ..@..",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1 0001.2.3.4 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111 4  111111111111111 12",
    "+1 (656) 555-6510 +49 30 (((((  +1234567890123456 +12345 ++1 2345678901",
    "😀 é a@b.co 😀 1.2.3.4 DE89 3704 0044 0532 0130 00 iban GB82WEST12345698765432 DE00 3704 0044 0532 0130 00",
    "ssn 123-45-6789, number 123-45-6780 and much more text follows here so that nothing is near. call (212) 555-0199",
    "a" * 3000 + "@" + "b." * 9000 + "c",
    "1" * 4000 + " " + "1 " * 20000 + "+" + "(" * 20000,
    "." * 20000 + "1.2.3.4" * 2000,
]


def test_personal_data_edges(docs_of):
    rows = pii.personal_data_digest(docs_of(list(enumerate(TRICKY)))).collect()
    assert len(rows) == len(TRICKY)
    for r in rows:
        want = base_spans(TRICKY[r.doc_id])
        assert r.base_sha256 == digest(want), r.doc_id
        for kind in pii.BASE:
            assert r[f"n_{kind}"] == sum(s[3] == kind for s in want)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].n_iban == 2 and by_id[7].n_ssn == 2 and by_id[7].n_tel == 1


def test_personal_data_on_the_table(spark, corpus):
    rows = {r.doc_id: r for r in QUERIES["op1_pii"](spark, FOLDER).collect()}
    assert len(rows) == len(corpus)
    for d in corpus:
        assert rows[d["doc_id"]].base_sha256 == digest(base_spans(d["text"])), d["doc_id"]


DENSE = [
    "12345, " * 40_000 + "4111 1111 1111 1111",
    "a.b@c.de call me, " * 55_000,
    "+1 (555) 010-9999 tel 555 010 9999 or x@y.zz; " * 5_000 + "é\U0001f600 10.0.0.1 " * 20_000,
]


def test_many_matches_in_one_text(docs_of):
    docs = docs_of(list(enumerate(DENSE)), partitions=1)
    docs.count()
    start = time.time()
    rows = {r.doc_id: r for r in pii.personal_data_digest(docs).collect()}
    assert time.time() - start < 40
    for i, text in enumerate(DENSE):
        want = base_spans(text)
        assert rows[i].base_sha256 == digest(want) and len(want) > 0
    assert rows[2].n_tel == 5_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101])
def test_sums_and_chunks(spark, n):
    steps = [3 * i % 7 for i in range(n)]
    got = spark.createDataFrame([(steps,)], "steps array<int>").select(pii.sums_before(F.col("steps"))).first()[0]
    assert got == [sum(steps[:i]) for i in range(n)]
    text = "é\U0001f600\n" * (n * 9)
    ends = [(a, k) for a in (0, 1, 255, 256, 257, 511, 700) for k in (0, 1, 40)]
    pieces = [pii._piece(pii._chunks(F.col("t")), F.lit(a), F.lit(k)).alias(f"c{i}") for i, (a, k) in enumerate(ends)]
    assert list(spark.createDataFrame([(text,)], "t string").select(*pieces).first()) == [text[a : a + k] for a, k in ends]


def test_context_moves_the_score(docs_of):
    found = pii.find_personal_data(docs_of([(1, "a@b.co is"), (2, "mail a@b.co")])).select("doc_id", F.explode("findings").alias("f"))
    scores = {r.doc_id: r.f.score for r in found.collect()}
    assert scores[2] > scores[1]


EDGES = [(1, "same"), (2, "same"), (None, "same"), (3, None), (4, ""), (5, "lone"), (5, "lone"), (6, " same"), (None, "x"), (None, "x"), (7, "y" * 100000)]


def test_exact_duplicates(docs_of):
    rows = exact.exact_duplicates(docs_of(EDGES)).collect()
    groups = defaultdict(list)
    for i, text in EDGES:
        groups[text or ""].append(i)
    assert len(rows) == len(EDGES)
    for r in rows:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_drop_exact_duplicates_keeps_one_and_all_columns(docs_of):
    docs = docs_of(EDGES).withColumns({"sha": F.lit(1), "maybe": F.lit("m"), "cell0": F.lit(2), "keep_id": F.lit(3)})
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "", r.doc_id or -1) for r in kept.collect()) == sorted(
        [("same", 2), ("", 4), ("lone", 5), (" same", 6), ("x", -1), ("y" * 100000, 7)]
    )
    assert exact.drop_exact_duplicates(docs.where("false")).count() == 0


def test_full_filter_stays_exact(docs_of, monkeypatch):
    monkeypatch.setattr(exact, "MAX_BITS", 16)
    monkeypatch.setattr(exact, "CELLS_PER_ROW", 1e-9)
    rows = exact.exact_duplicates(docs_of([(i, f"t{i // 3}") for i in range(3000)])).collect()
    assert all(r.group_size == 3 and r.keep_id == r.doc_id // 3 * 3 + 2 for r in rows)


def check_shards(rows, texts, shards):
    total = sum(r.size for r in rows)
    largest = max(r.size for r in rows)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        by[r.shard].append(r)
    ids = [r.doc_id if r.doc_id is not None else -1 for s in sorted(by) for r in by[s]]
    assert ids == sorted(ids), "contiguous in the order of ids"
    for s, members in by.items():
        assert [r.slot for r in members] == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / shards) <= largest
        assert all(r.law == "bytes" and r.grown_shard is None for r in members)


def test_shards(docs_of):
    docs = EDGES + [(i, "w" * (i % 50)) for i in range(10, 2000)] + [(None, str(i)) for i in range(500)]
    rows = sharding.shard_by_bytes(docs_of(docs), part_rows=100).collect()
    assert len(rows) == len(docs)
    check_shards(rows, None, 16)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in docs)


def test_shards_of_the_table_and_of_nothing(spark, corpus, docs_of):
    rows = QUERIES["op8_sharding"](spark, FOLDER).collect()
    assert len(rows) == len(corpus)
    check_shards(rows, None, 16)
    assert sharding.shard_by_bytes(docs_of([])).count() == 0


def targets_by_rounds(words):
    """Shares by weight; the excess of stopped sources goes round again."""
    names = sorted((n for n in words if n is not None), key=lambda n: n.encode()) + [None] * (None in words)
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, stopped = 1.5 * sum(words.values()), {}
    while True:
        free = [n for n in names if n not in stopped]
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 2 * words[n] + 1e-9]
        if not over:
            return share | stopped
        for n in over:
            stopped[n] = 2 * words[n]
            left -= stopped[n]


def seats_one_by_one(targets, house):
    held = dict.fromkeys(targets, 0)
    for _ in range(house):
        held[max(sorted(held), key=lambda n: (targets[n] / (2 * held[n] + 1), -n))] += 1
    return held


def check_mix(rows, words):
    want = targets_by_rounds(words)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for source, members in by.items():
        got = sum(r.taken for r in members)
        assert members[0].source_size == sum(r.size for r in members) == words[source]
        assert members[0].target == pytest.approx(want[source], rel=1e-9)
        assert abs(got - want[source]) <= max(3, 0.02 * want[source]), (source, got, want[source])
        assert all(0 <= r.taken <= 2 * r.size for r in members)


def test_mix_of_the_table(spark, corpus):
    words = defaultdict(int)
    for d in corpus:
        words[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    rows = QUERIES["op2_mixing"](spark, FOLDER)
    again = QUERIES["op2_mixing"](spark, FOLDER)
    sources = {d["doc_id"]: d["source"] for d in corpus}
    got = [type("R", (), r.asDict() | {"source": sources[r.doc_id]}) for r in rows.collect()]
    assert len(got) == len(corpus)
    check_mix(got, words)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def test_mix_edges(docs_of):
    rows = [(i, "a b c " * (i % 7), None, "big" if i % 3 else "hot") for i in range(400)]
    rows += [(500, "one two", None, None), (501, None, None, "void"), (502, "", None, "void"), (None, "x y", None, "Ä"), (None, "x y", None, "Ä")]
    rows += [(600, "w " * 5000, None, "long"), (601, "z", None, "")]
    words = defaultdict(int)
    for _, text, _, source in rows:
        words[source] += len((text or "").split())
    got = mixing.mix(docs_of(rows).withColumn("offset", F.lit(1))).collect()
    assert len(got) == len(rows)
    check_mix(got, words)
    assert mixing.mix(docs_of([])).count() == 0
    whole = mixing.mixed_documents(docs_of(rows).withColumn("taken", F.lit("own")))
    assert {r.taken for r in whole.collect()} == {"own"}
    assert mixing.mixed_documents(docs_of([])).count() == 0


def test_whole_documents_follow_targets_beside_a_tiny_source(spark):
    """A tiny source makes blocks of a few words; documents of every other source still meet its target."""
    rows = [(i, f"s{i % 21:02d}", 300 + i % 200) for i in range(21_000)]
    rows += [(100_000 + i, "hot", 300 + i % 200) for i in range(12_000)] + [(200_000 + i, "tiny", 500) for i in range(2)]
    frame = spark.createDataFrame([(i, "t", s, n) for i, s, n in rows], "doc_id long, text string, source string, n long").repartition(4)
    targets = {r.source: r.target for r in mixing.mix(frame, size_col="n").select("source", "target").distinct().collect()}
    assert len(targets) == 23
    got = mixing.mixed_documents(frame, size_col="n").groupBy("doc_id", "source", "n").count().collect()
    assert max(r["count"] for r in got) <= 2
    words = defaultdict(int)
    for r in got:
        words[r.source] += r.n * r["count"]
    assert words["hot"] == pytest.approx(targets["hot"], rel=0.05)
    off = {s: (words[s], t) for s, t in targets.items() if s != "tiny" and abs(words[s] - t) > 0.12 * t}
    assert not off, off


@pytest.mark.parametrize("targets", [[5.0, 3.0, 2.0], [100.0, 0.5, 0.0, 33.3], [1.0] * 7, [1000.0, 1.0, 1.0, 998.0]])
def test_quotas_are_sainte_lague(spark, targets):
    frame = spark.createDataFrame([(f"s{i}", i, t) for i, t in enumerate(targets)], "source string, rank int, target double")
    rows = mixing.block_quotas(frame, 1, shards=4).collect()
    house = round(sum(targets))
    for upto in range(1, 5):
        want = seats_one_by_one(dict(enumerate(targets)), house * upto // 4)
        got = defaultdict(int)
        for r in rows:
            got[r["rank"]] += r.quota * (r.shard < upto)
        assert dict(got) == want
    assert all(r.quota >= 0 for r in rows)


def test_repeated_cells_are_counted_and_sent_once(spark, docs_of, capsys):
    docs = docs_of([(i, f"text {i % 40}") for i in range(100)])
    flagged = exact.flag_repeats(docs.select("text"), "text")(docs, "maybe")
    assert {r.doc_id for r in flagged.collect() if r.maybe} == set(range(100))
    capsys.readouterr()
    flagged.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert plan.count("BroadcastHashJoin") == exact.PROBES
    assert plan.count("- BroadcastExchange") == 1 and plan.count("- ReusedExchange") == exact.PROBES - 1
