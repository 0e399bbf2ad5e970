"""The pipeline's stages, each on what the one before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from spoolworks.llm import pieces
from test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, rows = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, rows, FOLDER).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        kept[name] = rows.collect()
        assert rows.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    everything = docs.collect()

    letters = {r.doc_id for r in everything if re.search(r"[^\W\d_]", r.text or "")}
    known = {r.doc_id for r in kept["language_id"]}
    assert known <= letters and len(known) >= 0.97 * len(everything)

    last = {}
    for r in kept["language_id"]:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(last.values())

    groups = brute([(r.doc_id, r.text) for r in kept["exact_dedup"]])
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(d for d, _, c in groups if d == c)

    times = Counter(r.doc_id for r in kept["mixing"])
    assert set(times) <= {r.doc_id for r in kept["near_dedup"]} and max(times.values()) <= 2
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    before, after = sum(map(words, kept["near_dedup"])), sum(map(words, kept["mixing"]))
    assert abs(after / before - 1.5) < 0.1

    texts = defaultdict(str, {r.doc_id: r.text for r in kept["mixing"]})
    assert Counter(r.doc_id for r in kept["sentencepiece"]) == times
    back = pieces.decode_tokens(spark.read.parquet(str(tmp_path / "sentencepiece"))).collect()
    assert all(r.text == texts[r.doc_id] for r in back)


def test_stages_on_no_rows_and_on_nulls_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({c: F.lit(1) for c in ("id", "hash", "n", "tag", "score", "lang_pred", "size")})
    copy = "a text of no number that is here twice"
    edges = spark.createDataFrame([(None, copy), (None, copy), (None, None), (9_000_001, None), (9_000_002, ""), (9_000_003, " \n")], "doc_id long, text string")
    for name, start in (("none", docs.where("false")), ("edges", docs.unionByName(edges, allowMissingColumns=True))):
        rows = start
        for stage_name, stage in corpus_pipeline.STAGES:
            columns = rows.columns
            stage(spark, rows, FOLDER).write.parquet(str(tmp_path / name / stage_name))
            rows = spark.read.parquet(str(tmp_path / name / stage_name))
            assert rows.columns == columns or stage_name == corpus_pipeline.STAGES[-1][0]
        assert (rows.count() > 0) == (name == "edges")
        assert rows.where("doc_id > 9000000").count() == 0


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "lang", "source", "tokens"]


def test_batches_of_long_texts_are_bounded_and_a_set_limit_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    for k in (0, 2, 4):
        own, given = spark.newSession(), spark.newSession()
        given.conf.set(key, "123456")
        for session in (own, given):
            corpus_pipeline.STAGES[k][1](session, session.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
        rows = own.range(5000, numPartitions=1).select(F.repeat(F.lit("eight by"), 1000).alias("text"))
        got = rows.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 5000 and max(r.bytes for r in got) < 9 << 20
        assert given.conf.get(key) == "123456"
