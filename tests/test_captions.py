import pytest
from pyspark.sql import functions as F

from spoolworks.functions import images as I
from spoolworks.operators import captions as C
from spoolworks.operators import filters as FL
from spoolworks.plans import caption_data as CD
from spoolworks.sinks import files as K
from spoolworks.sources import files as S


def frame(spark, schema, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


@pytest.mark.parametrize("rule,expected", [
    ("loader", ["d/a.jpg", "d/images/a.jpg", "/abs/a.jpg", "d/a.jpg", "d"]),
    ("trainer", ["d/a.jpg", "d/images/a.jpg", "/abs/a.jpg", "d/a.jpg", "d/"]),
    ("joined", ["d/images/a.jpg", "d/images/images/a.jpg", "/abs/a.jpg", "d/a.jpg", "d/"]),
    ("input_dir", ["d/images/a.jpg", "d/images/images/a.jpg", "/abs/a.jpg", "a.jpg", ""]),
])
def test_paths(spark, rule, expected):
    df = frame(spark, "p string", "images/a.jpg", "images/images/a.jpg", "/abs/a.jpg", "a.jpg", "")
    assert [r[0] for r in df.select(I.normalize_image_path(F.col("p"), "d", rule)).collect()] == expected


def test_names(spark):
    df = frame(spark, "p string, n long", ("http://x/y/pic.jpeg", 1), ("x/pic.JPG", 2), ("pic.png", 3), ("nothing", 123456))
    assert [r[0] for r in df.select(I.kept_image_name(F.col("p"), F.col("n"))).collect()] == [
        "pic.jpeg", "flickr8k_2.jpg", "pic.png", "flickr8k_123456.jpg",
    ]
    assert [r[0] for r in df.select(I.split_image_name(F.lit("val"), F.col("n"))).collect()] == [
        "val_00001.jpg", "val_00002.jpg", "val_00003.jpg", "val_123456.jpg",
    ]


def test_explode_and_first(spark):
    df = frame(spark, "id long, c array<string>", (1, ["a", "b"]), (2, []), (3, None))
    assert sorted(map(tuple, C.explode_captions(df, "c").collect()), key=str) == [(1, "a"), (1, "b"), (3, None)]
    assert sorted((r.id, r.caption) for r in C.first_caption(df, "c").collect() if r.caption) == [(1, "a")]
    assert C.first_caption(df, "c").count() == 2
    scalar = frame(spark, "id long, c string", (1, "a"))
    assert C.explode_captions(scalar, "c").first().caption == "a"


def test_joins(spark):
    records = frame(spark, "id long, image_path string", (1, "a"), (2, "b"), (3, None), (4, "a"))
    files = frame(spark, "path string", "a", "a", "z")
    assert sorted(r.id for r in C.semi_join_images(records, files).collect()) == [1, 4]
    assert sorted(r.id for r in C.anti_join_missing(records, files).collect()) == [2, 3]
    left = {r.id: (r.has_image, r.image) for r in C.has_image_left_join(records, files).collect()}
    assert left == {1: (True, "a"), 2: (False, None), 3: (False, None), 4: (True, "a")}


def test_load_captions_precedence(spark):
    files = frame(spark, "path string", "/i/a.jpg")
    schema = "id long, image string, output string, caption string, captions array<string>"
    records = frame(
        spark, schema,
        (1, "images/a.jpg", "", "c", None), (2, "a.jpg", None, "c", None), (3, "/i/a.jpg", None, None, ["x", "y"]),
        (4, "a.jpg", None, None, []), (5, "a.jpg", None, None, None), (6, "gone.jpg", "o", None, None),
    )
    rows = sorted((r.id, r.caption, r.text) for r in C.load_captions(records, files, "/i", keep=["id"]).collect())
    say = "Describe this image in detail."
    assert rows == [(1, "", say), (2, "c", say), (3, "x", say), (3, "y", say), (5, "", say)]


SIGNATURES = {
    "jpeg": b"\xff\xd8\xff\xe0rest", "png": b"\x89PNG\r\n\x1a\nrest", "gif": b"GIF89a..", "bmp": b"BMxx",
    "webp": b"RIFF\x01\x02\x03\x04WEBPVP8", "tiff": b"II*\x00..",
}


def test_valid_image(spark):
    rows = [(k, v) for k, v in SIGNATURES.items()] + [("text", b"test image"), ("empty", b""), ("null", None)]
    df = frame(spark, "name string, content binary", *rows)
    assert {r.name: r.f for r in df.select("name", I.image_format(F.col("content")).alias("f")).collect() if r.f} == {k: k for k in SIGNATURES}
    assert C.valid_image(df).count() == len(SIGNATURES)


def test_scan_copy_and_write_once(spark, tmp_path):
    source = tmp_path / "in" / "deep"
    source.mkdir(parents=True)
    for name, data in (("a.jpg", SIGNATURES["jpeg"]), ("b.jpg", b"test image number 1.")):
        (source / name).write_bytes(data)
    narrow = S.scan_image_files(spark, str(tmp_path / "in"))
    assert narrow.count() == 2 and "content" not in narrow.columns
    files = C.valid_image(S.scan_image_files(spark, str(tmp_path / "in"), with_content=True))
    manifest = files.select(F.col("path").alias("src"), F.lit("train_00000.jpg").alias("dest"))
    out = tmp_path / "out"
    gone = manifest.select(F.lit(f"{tmp_path}/gone.jpg").alias("src"), F.lit("x/y.jpg").alias("dest"))
    first = K.copy_images(manifest.union(gone), f"file://{out}").collect()
    assert sorted((r.dest, r.status) for r in first) == [("train_00000.jpg", "written"), ("x/y.jpg", "missing")]
    assert (out / "train_00000.jpg").read_bytes() == SIGNATURES["jpeg"]
    assert [r.status for r in K.copy_images(manifest, f"file://{out}").collect()] == ["kept"]
    assert [p.name for p in out.iterdir() if not p.name.startswith(".")] == ["train_00000.jpg"]


def test_split_records_leave_gaps(spark):
    records = spark.range(20).select("id", F.concat(F.lit("images/"), F.col("id").cast("string")).alias("image"), F.lit("c").alias("output"))
    files = spark.range(20).where("id <> 7").select(F.concat(F.lit("/in/images/"), F.col("id").cast("string")).alias("path"))
    rows = CD.split_caption_records(records, files, "id", "/in").collect()
    assert len(rows) == 19
    numbers = {s: sorted(r["index"] for r in rows if r.split == s) for s in ("train", "val", "test")}
    everything = {"train": 16, "val": 2, "test": 2}
    assert sum(len(set(range(everything[s])) - set(numbers[s])) for s in everything) == 1
    sampled = CD.split_caption_records(records, files, "id", "/in", sample_size=10).collect()
    assert {r.id for r in sampled} <= {r.id for r in rows} and 9 <= len(sampled) <= 10


def test_vision_prompts_and_batches(spark):
    files = frame(spark, "path string", "/i/a.jpg")
    records = frame(spark, "id long, instruction string, caption string, image string",
                    (1, "i", "c", "a.jpg"), (2, None, "d", "gone.jpg"), (3, "j", None, None))
    rows = {r.id: r for r in CD.prepare_vision_prompts(records, files, "/i", keep=["id"]).collect()}
    assert [(rows[i].has_image, rows[i].image) for i in (1, 2, 3)] == [(True, "/i/a.jpg"), (False, None), (False, None)]
    assert rows[2].prompt.startswith("<start_of_turn>user\nDescribe this image in detail.")
    assert rows[3].response == "<end_of_turn>"
    batch = frame(spark, "batch_id long, text string, caption string, image string", (0, "t", "a b", "p"), (0, "t", "a", "p"))
    made = CD.collate_vision(batch, max_length=4).collect()
    assert len({len(r.input_ids) for r in made}) == 1 and all(r.over_length for r in made)
    assert all(label in (-100, token) for r in made for label, token in zip(r.labels, r.input_ids))


def test_real_files_heads_and_copies(spark, tmp_path):
    source = tmp_path / "in"
    bodies = frame(spark, "dest string, n long, content binary", ("a.jpg", 2, SIGNATURES["png"]), ("a.jpg", 1, SIGNATURES["jpeg"]), ("b.jpg", 3, b"text"), ("c.jpg", 4, None))
    copied = K.copy_images(bodies, str(source), src="n", content="content")
    assert sorted((r.dest, r.src, r.status) for r in copied.collect()) == [("a.jpg", "1", "written"), ("b.jpg", "3", "written"), ("c.jpg", "4", "missing")]
    assert sorted((r.dest, r.src, r.status) for r in copied.collect())[0][2] == "written", "reading the statuses again copies nothing"
    assert (source / "a.jpg").read_bytes() == SIGNATURES["jpeg"]
    assert sorted(r.n for r in K.drop_failed_copies(bodies, copied, src="n").collect()) == [1, 3]
    heads = {r.path: r.head for r in K.read_heads(frame(spark, "path string", (f"{source}/a.jpg",), (f"file:{source}/b.jpg",), (f"{source}/z.jpg",))).collect()}
    assert list(map(type, heads.values())).count(type(None)) == 1 and heads[f"file:{source}/b.jpg"] == b"text"
    records = frame(spark, "id long, image string, caption array<string>", (1, "a.jpg", ["x", "y", "z"]), (2, "b.jpg", ["t"]), (3, "c.jpg", ["u"]))
    files = S.scan_image_files(spark, str(source)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    rows = CD.load_vision_records(records, files, str(source), keep=["id"], limit=2, order_key="id", check_heads=True)
    assert sorted((r.id, r.caption) for r in rows.collect()) == [(1, "x"), (1, "y")]
    with pytest.raises(ValueError, match="order_key"):
        CD.load_vision_records(records, files, str(source), limit=2)
    shown = CD.prepare_vision_prompts(records.select("id", "image", F.lit("c").alias("caption")), files, str(source), keep=["id"], check_heads=True)
    assert {r.id: r.has_image for r in shown.collect()} == {1: True, 2: False, 3: False}


def test_limit_before_or_after_valid(spark):
    records = frame(spark, "id long, image string, caption string", *[(i, f"{i}.jpg", "c") for i in range(6)])
    files = frame(spark, "path string", *[f"/i/{i}.jpg" for i in range(6)])
    content = frame(spark, "path string, content binary", *[(f"/i/{i}.jpg", SIGNATURES["png"] if i > 1 else b"x") for i in range(6)])

    def ids(after):
        rows = CD.load_vision_records(records, files, "/i", content, keep=["id"], limit=3, order_key="id", limit_after_valid=after)
        return sorted(r.id for r in rows.collect())

    assert ids(after=False) == [2] and ids(after=True) == [2, 3, 4]


def test_quarantine_and_require(spark):
    from pyspark.sql import types as T

    df = frame(spark, "id long, js string", (1, '{"a": 1}'), (2, '{"a": '), (3, "junk"), (4, None), (5, '{"a": "x"}'), (6, "{}"))
    good, bad = FL.quarantine_bad_rows(df, "js", T.StructType([T.StructField("a", T.LongType())]))
    assert sorted((r.id, r.a) for r in good.collect()) == [(1, 1), (6, None)]
    assert sorted(r.id for r in bad.collect()) == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        FL.require_rows(df.where("id > 10"))
    assert FL.require_rows(df) is df
    assert FL.require_every(df, F.col("id") > 0, "bad id").count() == 6
    with pytest.raises(Exception, match="no json"):
        FL.require_every(df, F.length("js") > 0, "no json").collect()
