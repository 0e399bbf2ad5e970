import dataclasses
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks import schemas, scratch_root, write_through
from spoolworks.operators import ranking as R
from spoolworks.plans import catalog, queries_images, queries_io
from spoolworks.plans.metric_data import metric_series
from spoolworks.plans.standins import Tables
from spoolworks.sinks import files as K
from spoolworks.sources import files as S

RECORDS = [{"instruction": "é\n\"q\"\\", "input": "", "output": "日本 😀"}, {"instruction": "b", "output": None}, {"output": "c", "extra": 1}]


def test_json_array_and_lines(spark, tmp_path):
    one = tmp_path / "one.json"
    one.write_text(json.dumps(RECORDS, indent=2, ensure_ascii=False), encoding="utf-8")
    want = [("é\n\"q\"\\", "", "日本 😀"), ("b", None, None), (None, None, "c")]
    assert [tuple(r) for r in S.scan_json_array(spark, str(one), schemas.INSTRUCTION).collect()] == want
    assert [tuple(r) for r in S.scan_json_or_jsonl(spark, str(one), schemas.INSTRUCTION).collect()] == want
    for name in ("lines.jsonl", "lines.json"):
        (tmp_path / name).write_text("\n".join(map(json.dumps, RECORDS)))
        assert [tuple(r) for r in S.scan_json_or_jsonl(spark, str(tmp_path / name), schemas.INSTRUCTION).collect()] == want
    inferred = S.scan_json_or_jsonl(spark, str(tmp_path / "lines.jsonl"))
    assert set(inferred.columns) == {"instruction", "input", "output", "extra"}
    with pytest.raises(ValueError):
        S.scan_json_or_jsonl(spark, "x.csv")


@pytest.mark.parametrize("ascii_only", [False, True])
@pytest.mark.parametrize("rows", [0, 1, 7])
def test_array_files_load_as_json(spark, tmp_path, ascii_only, rows):
    df = spark.range(0, rows, 1, 3).select("id", F.lit("é 😀 \" \\ \n").alias("t"))
    path = tmp_path / "out.json"
    K.write_json(df, str(path), layout="array", ascii_only=ascii_only)
    loaded = []
    for part in path.glob("part-*"):
        raw = part.read_bytes() or b"[]"  # a frame known to be empty leaves an empty file
        assert not ascii_only or raw.isascii()
        loaded += json.loads(raw)
    assert sorted(r["id"] for r in loaded) == list(range(rows)) and all(r["t"] == "é 😀 \" \\ \n" for r in loaded)
    assert S.scan_json_or_jsonl(spark, str(path), df.schema).count() == rows


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (4, "train")], "id long, split string")
    K.write_split_files(df, str(tmp_path / "d"), "set")
    schema = T.StructType([T.StructField("id", T.LongType())])
    start = str(tmp_path / "d" / "set_val.json")
    got = {s: sorted(r.id for r in S.scan_split_file(spark, start, s, "set", schema).collect()) for s in ("train", "val", "test")}
    assert got == {"train": [1, 4], "val": [2], "test": [3]}
    with pytest.raises(FileNotFoundError):
        S.scan_split_file(spark, start, "dev", "set", schema)
    K.write_splits(df, str(tmp_path / "p"))
    K.write_splits(df, str(tmp_path / "even"), rebalance=True)
    assert spark.read.parquet(str(tmp_path / "even")).count() == 4
    pruned = spark.read.parquet(str(tmp_path / "p")).where("split = 'val'")
    assert "PartitionFilters: [isnotnull(split" in pruned._jdf.queryExecution().executedPlan().toString()


def test_dataset_paths(spark, tmp_path):
    (tmp_path / "images").mkdir()
    assert S.dataset_paths(spark, f"{tmp_path}/x.json") == (f"{tmp_path}/x.json", f"{tmp_path}/images")
    assert S.dataset_paths(spark, f"{tmp_path}/no/x.json") == (f"{tmp_path}/no/x.json", f"{tmp_path}/no/x.json/images")
    assert S.dataset_paths(spark, str(tmp_path)) == (f"{tmp_path}/flickr8k_test_data.json", f"{tmp_path}/images")


def test_named_and_first_available(spark, tmp_path):
    spark.createDataFrame([(1, "train"), (2, "validation")], "id long, split string").createOrReplaceTempView("named_t")
    spark.createDataFrame([(1, "b"), (2, "a")], "id long, split string").createOrReplaceTempView("named_u")
    assert [r.id for r in S.scan_named(spark, "named_t", "validation").collect()] == [2]
    assert [r.id for r in S.scan_named(spark, "named_t", "dev").collect()] == [1]
    assert [r.id for r in S.scan_named(spark, "named_u").collect()] == [2]
    assert S.scan_eval_split(spark, "named_t", None) is None
    assert S.scan_eval_split(spark, "named_t", "dev") is None
    assert S.scan_eval_split(spark, "named_t", "validation").count() == 1
    df = S.scan_first_available(spark, ["nope", str(tmp_path / "nope.jsonl"), lambda: 1 / 0, "named_t"])
    assert df.count() == 2
    with pytest.raises(ValueError, match="last error"):
        S.scan_first_available(spark, ["nope", "also_nope"])


def test_from_records_and_csv(spark, tmp_path):
    df = S.from_records(spark, RECORDS, schemas.INSTRUCTION)
    assert df.columns == ["instruction", "input", "output"] and df.first().input == ""
    (tmp_path / "m.csv").write_text("step,loss\n1,0.5\n2,\n")
    schema = T.StructType([T.StructField("step", T.LongType()), T.StructField("loss", T.DoubleType())])
    table = S.scan_metrics_csv(spark, str(tmp_path / "m.csv"), schema)
    assert [tuple(r) for r in metric_series(table=table).collect()] == [(1, "loss", 0.5)]


def test_trainer_states(spark, tmp_path):
    for run, checkpoint, losses in (("a", 2, [1.0]), ("a", 4, [1.0, 0.5]), ("b", 2, [3.0])):
        folder = tmp_path / run / f"checkpoint-{checkpoint}"
        folder.mkdir(parents=True)
        history = [{"epoch": 0.1, "loss": x, "step": i + 1, "learning_rate": 1e-5} for i, x in enumerate(losses)]
        history.append({"epoch": 0.1, "step": len(losses), "train_runtime": 5.0})
        (folder / "trainer_state.json").write_text(json.dumps({"global_step": checkpoint, "log_history": history}, indent=2))
    states = S.read_trainer_states(spark, f"{tmp_path}/*/*/trainer_state.json").withColumn("run", F.regexp_extract("path", "([^/]+)/checkpoint", 1))
    rows = metric_series(states, path="path").collect()
    assert sorted((r.run, r.step, r.value) for r in rows if r.tag == "loss") == [("a", 1, 1.0), ("a", 2, 0.5), ("b", 1, 3.0)]
    assert {r.tag for r in rows} == {"loss", "learning_rate", "train_runtime"}


def test_run_registry(spark, tmp_path):
    @dataclasses.dataclass
    class Settings:
        lr: float = 1e-5
        tags: tuple = ("a",)

    class Plain:
        def __init__(self):
            self.path = "x"

    for run in ("one", "two"):
        K.write_run_info(K.run_info(spark, run, Settings(), Plain(), {"seed": 42}, {"loss": 1}), str(tmp_path / "runs"))
    rows = {r.run: r for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert set(rows) == {"one", "two"}
    assert json.loads(rows["one"].model_args) == {"lr": 1e-5, "tags": ["a"]}
    assert json.loads(rows["one"].data_args) == {"path": "x"} and rows["one"].final_metrics == {"loss": 1.0}


def test_one_registry_row_per_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    row = lambda run, loss: K.run_info(spark, run, {"a": 1}, {}, {}, {"loss": loss})
    K.write_run_info(row("one", 3).union(row("two", 2)).union(row(None, 1)), path)
    K.write_run_info(row("one", 1), path)
    assert {r.run: r.final_metrics["loss"] for r in K.read_run_info(spark, path).collect()} == {"one": 1.0, "two": 2.0, None: 1.0}
    # writers at the same time: all commit, each run has one row
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: K.write_run_info(row("two", 10 + i).union(row(f"own{i}", i)), path), range(4)))
    rows = K.read_run_info(spark, path).collect()
    assert sorted(r.run or "" for r in rows) == ["", "one", "own0", "own1", "own2", "own3", "two"]
    assert K.run_versions(spark, path).count() == 12
    last = max(K.run_versions(spark, path).where("run = 'two'").collect(), key=lambda r: r.version)
    assert {r.run: r for r in rows}["two"].final_metrics == last.final_metrics
    K.write_run_info(row("two", 0).limit(0), path)
    K.write_run_info(row("one", 5).union(row("one", 7)), path)
    assert {r.run: r.final_metrics["loss"] for r in K.read_run_info(spark, path).collect()}["one"] == 7.0


def test_scratch_follows_the_session_setting(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = write_through(spark.range(5), "five")
    assert kept.count() == 5 and scratch_root(spark) in kept.inputFiles()[0]


def test_mixed_folders_globs_and_pretty_objects(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text('\n [ {"id": 1}, {"id": 2} ]')
    (folder / "b.json").write_text('{"id": 3}\n{"id": 4}\n{"id": 5}\n')
    (folder / "c.json").write_text('{\n  "id": 6\n}')
    (folder / "d.json").write_text("")
    (folder / "e.json").write_text('{"id": 7}')
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert sorted(r.id for r in S.scan_json_or_jsonl(spark, str(folder), schema).collect()) == list(range(1, 8))
    assert sorted(r.id for r in S.scan_json_or_jsonl(spark, f"{folder}/[ab].json", schema).collect()) == [1, 2, 3, 4, 5]
    assert S.scan_json_or_jsonl(spark, f"{folder}/b.json", schema, layout="lines").count() == 3
    with pytest.raises(FileNotFoundError):
        S.scan_json_or_jsonl(spark, f"{tmp_path}/nothing*.json", schema)
    (tmp_path / "bad.json").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        S.scan_json_or_jsonl(spark, f"{tmp_path}/bad.json", schema).collect()


def test_every_split_name_is_written(spark, tmp_path):
    df = R.split_percent(spark.range(1000), "id", 10)
    assert K.write_split_files(df, f"{tmp_path}/out", "set") == ["train", "validation"]
    schema = T.StructType([T.StructField("id", T.LongType())])
    rows = {s: S.scan_split_file(spark, f"{tmp_path}/out/set_train.json", s, "set", schema).count() for s in ("train", "validation")}
    assert rows == {"train": 900, "validation": 100}
    with pytest.raises(Exception, match="no split"):
        K.write_split_files(spark.createDataFrame([(1, None)], "id long, split string"), f"{tmp_path}/none", "set")


def test_schemes_of_copies():
    assert K.plain_uri("/a/b") == K.plain_uri("file:/a/b") == K.plain_uri("file:///a/b") == "file:///a/b"
    assert K.plain_uri("s3a://bucket/x") == "s3://bucket/x" and K.plain_uri("hdfs://n:1/x") == "hdfs://n:1/x"
    with pytest.raises(ValueError, match="wasb"):
        K.plain_uri("wasb://a/b")


def test_copied_images_are_whole(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    bodies = {r.path.rpartition("/")[2]: len(r.content) for r in queries_images.contents(t).collect()}
    folder, _ = queries_images.image_folder(t)
    assert {r.path.rpartition("/")[2]: r.length for r in S.scan_image_files(spark, folder).collect()} == bodies
    assert max(bodies.values()) > 200
    folder, manifest, copied = queries_images.manifest_copies(t)
    texts = {r.doc_id: len(r.text.encode()) for r in t.documents.collect()}
    first = {}
    for r in manifest.collect():
        first[r.dest] = min(r.doc_id, first.get(r.dest, r.doc_id))
    want = {dest: 4 + texts[doc] for dest, doc in first.items()}
    assert {r.path.rpartition("/")[2]: r.length for r in S.scan_image_files(spark, folder).collect()} == want
    assert {r.status for r in copied.collect()} == {"written"}


def test_trainer_states_come_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(queries_io, "STATE_STEPS", 7)
    t = Tables(spark, "/root/testdata/sf0.001")
    steps = {str(r.user_id): r["count"] for r in t.events.groupBy("user_id").count().collect()}
    assert max(steps.values()) > 7
    states = queries_io.trainer_states(t).select("run", "path", F.size("log_history").alias("n")).collect()
    assert max(r.n for r in states) <= 7
    assert {run: sum(r.n for r in states if r.run == run and "checkpoint-00000002" in r.path) for run in steps} == steps
    got = catalog.callables()["scan_trainer_states"](spark, "/root/testdata/sf0.001").collect()
    assert {r.run: (r.step, r.entries) for r in got} == {run: (n, 2 * n) for run, n in steps.items()}


def test_listed_folders_agree_with_the_file_index(spark, tmp_path):
    root = tmp_path / "in x"
    names = ["a b.jpg", "é%20+#.jpg", "_x", "_x=1", ".h", "_metadata", "c._COPYING_", "_skip/f", "k=1/p/q/r.bin", "k=1/_metadata1", "sub/.d/x", "sub/y"]
    for i, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * i)
    (root / "none").mkdir()
    (root / "link").symlink_to(root / "sub")
    (root / "gone").symlink_to(root / "nothing")
    index = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    want = sorted(tuple(r) for r in index.select("path", "modificationTime", "length").collect())
    listed = sorted(tuple(r) for r in S.scan_image_files(spark, str(root)).collect())
    assert [r for r in listed if r[2]] == want and {r[0].rpartition("/")[2] for r in want} == {"é%20+#.jpg", "_x=1", "r.bin", "y"}
    assert [r[0].rpartition("/")[2] for r in listed if not r[2]] == ["a b.jpg"], "the index passes over empty files; they are files"
    assert sorted(tuple(r) for r in S.scan_image_files(spark, f"file://{root}/").collect()) == listed
    assert S.scan_image_files(spark, f"{root}/none").collect() == []
    # globs and single files as before
    assert [r.length for r in S.scan_image_files(spark, f"{root}/su*/y").collect()] == [11] == [r.length for r in S.scan_image_files(spark, f"{root}/sub/y").collect()]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.scan_image_files(spark, f"{root}/nowhere")


def test_many_files_are_no_many_tasks(spark, tmp_path):
    for i in range(1200):
        (tmp_path / f"{i % 30}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 30}" / f"{i}.bin").write_bytes(b"x")
    listed = S.scan_image_files(spark, str(tmp_path))
    assert listed.count() == 1200
    assert listed.rdd.getNumPartitions() <= 2 * 8, "the rows of a table, not a task for every 32 files"


def test_a_task_opens_the_target_once(spark, tmp_path, monkeypatch):
    """The helpers as a task calls them: the store is opened and each folder made once, not for every file."""
    opened, real = [], K._open_file_system
    monkeypatch.setattr(K, "_open_file_system", lambda uri: opened.append(uri) or real(uri))
    folder = K._Folder(f"file://{tmp_path}/out")
    for i in range(20):
        assert K._stage_one(None, folder, f"d{i % 3}/{i}.bin", b"x" * i, True, f"_a/{i}") == ("staged", f"_a/{i}")
        assert K._publish_one(folder, f"d{i % 3}/{i}.bin", f"_a/{i}") == "written"
    assert len(opened) == 1 and folder.made == {f"{tmp_path}/out/{d}" for d in ("_a", "d0", "d1", "d2")}
    assert {p.name: p.stat().st_size for p in (tmp_path / "out").rglob("*.bin")} == {f"{i}.bin": i for i in range(20)}
    assert K._publish_one(folder, "d0/0.bin", "_a/0") == "written", "moved by an earlier attempt"
    assert K._publish_one(folder, "d0/new.bin", "_a/gone") == "failed"
    assert K._stage_one(None, folder, "d0/0.bin", b"y", True, "_a/99") == ("kept", None)
