"""Language spans: accuracy on held-out rows, mixed texts, edges."""

import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spoolworks.llm import language
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, corpus):
    rows = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, FOLDER).collect()}
    assert len(rows) == len(corpus)
    out = [d for d in corpus if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in out} == {i for i, r in rows.items() if r.held_out}
    assert sum(rows[d["doc_id"]].lang_pred == d["lang"] for d in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())


def best_path(scores, switch):
    """Every path, one by one."""
    n, k = scores.shape
    best, found = -1e18, None
    for code in range(k**n):
        path = [code // k**i % k for i in range(n)]
        value = sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        if value > best + 1e-9:
            best, found = value, path
    return best, found


def test_viterbi_against_every_path():
    rng = np.random.default_rng(3)
    scores = -rng.random((40, 3)) * 4
    lengths = [7, 1, 0, 5, 6]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    word = rng.integers(0, 40, starts[-1])
    labels = language.viterbi(scores, word, starts, switch=1.5)
    for a, b in zip(starts, starts[1:]):
        own = scores[word[a:b]]
        got = sum(own[i, p] for i, p in enumerate(labels[a:b])) - 1.5 * sum(labels[a:b][1:] != labels[a:b][:-1])
        if b > a:
            assert abs(got - best_path(own, 1.5)[0]) < 1e-9


EN = "the house and the garden with that which they were going through this morning"
FR = "les maisons et les jardins avec toutes ces choses que nous avons vues dans la rue"
RU = "дома и сады которые мы видели сегодня утром на улице"


def test_mixed_texts_scripts_and_edges(docs_of):
    rows = [(i, EN + f" {i}", "en") for i in range(40)] + [(i, FR, "fr") for i in range(40, 80)] + [(i, RU, "ru") for i in range(80, 120)]
    rows += [(200, f"{EN} {FR}"), (201, None), (202, ""), (203, "123 ... 45"), (204, "ζωή"), (None, EN), (205, FR + " 7", "fr"), (205, FR + " 7", "fr"), (206, EN * 3000), (207, "улице")]
    docs = docs_of(rows)
    model = language.train(docs)
    got = [r.asDict() for r in language.identify(docs, model, spans_name="spans").collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[201]["lang_pred"] == by[202]["lang_pred"] == by[203]["lang_pred"] == "und" and by[201]["score"] == 0
    assert by[None]["lang_pred"] == "en" and by[206]["lang_pred"] == "en" and by[205]["lang_pred"] == "fr" and by[207]["lang_pred"] == "ru"
    spans = by[200]["spans"]
    assert [s.lang for s in spans] == ["en", "fr"]
    assert spans[0].n_words == len(EN.split()) and spans[1].word == len(EN.split())
    assert by[204]["lang_pred"] in model["langs"]


def test_rejection_and_clashing_columns(docs_of):
    rows = [(i, EN, "en") for i in range(20)] + [(i, FR, "fr") for i in range(20, 40)] + [(50, "42"), (51, None)]
    docs = docs_of(rows).withColumnsRenamed({"n_chars": "lang_pred"}).selectExpr("*", "1 AS score")
    kept = language.keep_known_language(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_no_rows_and_nothing_learned(docs_of):
    assert language.predict(docs_of([])).count() == 0
    (row,) = language.predict(docs_of([(1, "some words")])).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_labels_of_held_out_rows_are_never_learned(docs_of):
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    model = language.train(docs_of([(i, EN, "secret" if i in out else "en") for i in range(400)]))
    assert model["langs"] == ["en"]
    assert not re.search("secret", str(model["langs"]))


def test_a_column_of_a_results_name_is_replaced(docs_of):
    docs = docs_of([(1, "one two three"), (2, None)]).withColumns({"score": F.lit("old"), "lang": F.lit("en"), "other": F.lit(1)})
    got = language.identify(docs, language.train(docs))
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    assert {r.doc_id: r.score for r in got.collect()}[2] == 0.0


def test_memory_of_a_slice_of_distinct_words(docs_of):
    model = language.train(docs_of([(i, EN, "en") for i in range(20)] + [(i, FR, "fr") for i in range(20, 40)]))
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, (200_000, 9)).astype(np.uint8)
    letters[:, 8] = 32
    texts = pa.array([letters[a : a + 500].tobytes().decode() for a in range(0, len(letters), 500)])
    tracemalloc.start()
    names, score, _ = language._label(texts, model, False)
    counted = list(language._training_counts(iter([pa.record_batch([texts, names], names=["text", "lang"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(names) == len(score) == 400 and sum(b.num_rows for b in counted)
    assert peak < 100 * texts.nbytes


def test_runs_of_words_change_no_result(docs_of, monkeypatch):
    rows = [(i, f"{EN} {i} {'x' * i}", "en") for i in range(40)] + [(i, f"{FR} {RU}", "fr") for i in range(40, 80)] + [(90, None), (91, ""), (92, "12 34")]
    docs, texts, found = docs_of(rows), pa.array([r[1] for r in rows]), []
    for size in (1, 40, 1 << 30):
        monkeypatch.setattr(language, "WORD_BYTES", size)
        model = language.train(docs)
        counted = [b.to_pydict() for b in language._training_counts(iter([pa.record_batch([texts, pa.array(["en"] * len(rows))], names=["text", "lang"])]))]
        found.append((model["langs"], model["table"].tobytes(), counted, [x.to_pylist() for x in language._label(texts, model, True)]))
    assert found[0] == found[1] == found[2]
    assert {"en", "fr"} <= set(found[0][3][0])
