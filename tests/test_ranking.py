import datetime
import decimal
import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spoolworks.operators import ranking as R


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def expected_split(n, val=0.1, test=0.1):
    ids = order(range(n))
    n_val, n_test = int(n * val), int(n * test)
    n_train = n - n_val - n_test
    return {i: "train" if at < n_train else "val" if at < n_train + n_val else "test" for at, i in enumerate(ids)}


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 1000])
def test_split_sizes_and_rows(spark, n):
    df = spark.range(n)
    want = expected_split(n)
    assert {r.id: r.split for r in R.split_exact(df, "id").collect()} == want
    ranked = R.split_exact_ranked(df, "id").collect()
    assert {r.id: r.split for r in ranked} == want
    for name in ("train", "val", "test"):
        index = sorted(r["index"] for r in ranked if r.split == name)
        assert index == list(range(len(index)))


@pytest.mark.parametrize("val,test", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.5, 0.5), (0.33, 0.2)])
def test_split_fractions(spark, val, test):
    want = expected_split(101, val, test)
    assert {r.id: r.split for r in R.split_exact(spark.range(101), "id", val, test).collect()} == want
    assert {r.id: r.split for r in R.split_exact_ranked(spark.range(101), "id", val, test).collect()} == want


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_same_for_any_partitioning(spark, partitions):
    df = spark.range(0, 500, 1, partitions)
    ids = order(range(500))
    assert {r.id: r["rank"] for r in R.shuffle_rank(df, "id").collect()} == {i: at for at, i in enumerate(ids)}
    assert {r.id for r in R.sample_exact(df, 77, "id").collect()} == set(ids[:77])


def test_splits_are_disjoint_and_complete(spark):
    parts = R.split_exact(spark.range(300), "id").withColumnRenamed("split", "s")
    train, rest = parts.where("s = 'train'").select("id"), parts.where("s <> 'train'").select("id")
    assert train.intersect(rest).count() == 0
    assert train.unionAll(rest).distinct().count() == 300


@pytest.mark.parametrize("n", [0, 1, 40, 99, 100, 101, 5000])
def test_methods_give_the_same_rows(spark, n):
    df = spark.range(100)
    small = {r.id for r in R.sample_exact(df, n, "id", method="sort").collect()}
    first = {r.id for r in R.limit_first(df, n, "id", method="sort").collect()}
    assert {r.id for r in R.sample_exact(df, n, "id", method="rank").collect()} == small
    assert {r.id for r in R.limit_first(df, n, "id", method="rank").collect()} == first
    assert len(small) == min(n, 100)
    with pytest.raises(ValueError):
        R.sample_exact(df, n, "id", method="other")


KEYS = {
    "string": [f"img_{i:07d}" for i in range(300)] + ["", "img", "é", "zz"],
    "date": [datetime.date(1969, 1, 1) + datetime.timedelta(days=i) for i in range(300)],
    "timestamp_ntz": [datetime.datetime(1969, 12, 31, 23, 59, 30) + datetime.timedelta(milliseconds=437 * i) for i in range(300)],
    "timestamp": [datetime.datetime(1969, 12, 31, 23, 59, 30) + datetime.timedelta(milliseconds=437 * i) for i in range(300)],
    "long": [3**i % 100003 for i in range(30)] + [-5, -(2**62), 2**62],
    "decimal(20,3)": [decimal.Decimal(i) / 8 for i in range(-50, 50)],
    "binary": [bytes([1, i, 7]) for i in range(200)],
    "boolean": [False, True],
    "double": [float("-inf"), -1.5, 0.0, 2.5, float("inf"), float("nan")],
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("piece_rows,max_cuts", [(250_000, 4096), (10, 4096), (1, 3)])
def test_ranks_by_any_type_of_key(spark, monkeypatch, kind, piece_rows, max_cuts):
    monkeypatch.setattr(R, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(R, "MAX_CUTS", max_cuts)
    keys = [*dict.fromkeys(KEYS[kind]), None]
    df = spark.createDataFrame([(k,) for k in keys], f"k {kind}")
    plain = df.withColumn("want", F.row_number().over(Window.orderBy("k")) - 1)
    ranked = R.input_rank(df, "k").join(plain.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")))
    assert ranked.count() == len(keys) and ranked.where("rank <> want").count() == 0


def test_pieces_stay_small_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE_ROWS", 50)
    monkeypatch.setattr(R, "MAX_CUTS", 8)
    largest = []
    for n in (1000, 4000, 16000):
        tagged = R.with_range_segment(spark.range(n), "id")
        largest.append(tagged.groupBy("__seg").count().agg(F.max("count")).first()[0])
    assert max(largest) <= 4 * 50, largest
    digits = [spark.range(n).limit(1).select(R.sized_digits(spark.range(n))).first()[0] for n in (100, 50 * 16**5)]
    assert digits == [4, 5]


OUTLIERS = {
    "paths": ("string", lambda i: f"s3://bucket/a/very/long/common/beginning/part-{i:07d}.jpg"),
    "wide longs": ("long", lambda i: 2**62 + i),
    "negative longs": ("long", lambda i: -(2**62) - 3 * i),
    "decimals": ("decimal(18,2)", lambda i: decimal.Decimal(9 * 10**15) + decimal.Decimal(i) / 100),
    "bytes": ("binary", lambda i: b"\0\xff" * 9 + i.to_bytes(4)),
}


@pytest.mark.parametrize("max_cuts", [4096, 4])
@pytest.mark.parametrize("name", sorted(OUTLIERS))
def test_outliers_and_common_beginnings_leave_pieces_even(spark, monkeypatch, name, max_cuts):
    monkeypatch.setattr(R, "PIECE_ROWS", 250)
    monkeypatch.setattr(R, "MAX_CUTS", max_cuts)
    kind, key = OUTLIERS[name]
    odd = {"string": ["", "zebra"], "binary": [b"", b"z"]}.get(kind, [type(key(0))(0), type(key(0))(1)])
    keys = [*map(key, range(3000)), *odd]
    df = spark.createDataFrame([(k,) for k in keys], f"k {kind}").repartition(4)
    tagged = R.with_range_segment(df, "k")
    sizes = [r["count"] for r in tagged.groupBy("__seg").count().collect()]
    assert max(sizes) <= (500 if max_cuts > 12 else 1000) and sum(sizes) == 3002
    ranked = R.input_rank(df, "k").collect()
    assert [r.k for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(keys)


def test_shuffle_seeded(spark):
    assert [r.id for r in R.shuffle_seeded(spark.range(50), "id", 7).collect()] == order(range(50), 7)


def test_input_rank_with_nulls_and_negatives(spark, monkeypatch):
    ids = [None, -5, -1, 0, 3, 4, 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert {r.id: r["rank"] for r in R.input_rank(df, "id", pieces=3).collect()} == {i: at for at, i in enumerate(ids)}
    assert {r.id: r["rank"] for r in R.input_rank(df, "id").collect()} == {i: at for at, i in enumerate(ids)}
    monkeypatch.setattr(R, "PIECE_ROWS", 10)
    assert R.input_rank(spark.range(200), "id").where("rank = id").count() == 200
    same = spark.createDataFrame([(5,)], "id long")
    assert R.input_rank(same, "id").first()["rank"] == 0
    assert R.input_rank(spark.range(0), "id").count() == 0


@pytest.mark.parametrize("hot_rows", [0, 500, 10**6])
def test_hot_group_ranks_equal_a_plain_window(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(R, "HOT_ROWS", hot_rows)
    # one group holds most of the rows, one is null
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    ranked = R.running_index(df, "id", ("g",))
    plain = Window.partitionBy("g").orderBy(R.seeded_hash(F.col("id")), "id")
    wrong = ranked.withColumn("w", F.row_number().over(plain) - 1).where("w <> index")
    assert ranked.count() == 3000 and wrong.count() == 0


def test_null_order_keys_and_other_group_types(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT_ROWS", 3)
    df = spark.range(40).select(
        "id", (F.col("id") % 3 == 0).alias("flag"), F.when(F.col("id") % 4 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int"))).alias("day"),
        F.when(F.col("id") % 5 > 0, F.timestamp_seconds(F.col("id") * 1800)).alias("ts"),
    )
    order = [F.col("ts"), F.col("id")]
    for groups in ((), ("flag",), ("day",), ("flag", "day")):
        ranked = R.exact_rank(df, order, F.date_trunc("hour", F.col("ts")), groups)
        plain = Window.partitionBy(*groups).orderBy(*order)
        wrong = ranked.withColumn("w", F.row_number().over(plain) - 1).where("w <> rank")
        assert ranked.count() == 40 and wrong.count() == 0
        assert set(ranked.columns) == {"id", "flag", "day", "ts", "rank"}


def test_rank_before_and_after_a_filter(spark):
    df = spark.range(3)
    before = R.input_rank(df, "id", name="index").where("id <> 1")
    after = R.input_rank(df.where("id <> 1"), "id", name="index")
    assert sorted(r["index"] for r in before.collect()) == [0, 2]
    assert sorted(r["index"] for r in after.collect()) == [0, 1]


def test_first_writer_latest_and_last_n(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "name string, k long, v string")
    assert sorted(map(tuple, R.first_writer_wins(df, "name", "k").collect())) == [("a", 1, "x"), ("b", 3, "z")]
    assert {r.name: r.v for r in R.latest_artifact(df, "name", "v").collect()} == {"a": "y", "b": "z"}
    steps = spark.range(20).select((F.col("id") % 2).alias("run"), F.col("id").alias("step"))
    kept = R.keep_last_n(steps, "run", "step", 3)
    assert sorted(r.step for r in kept.collect()) == [14, 15, 16, 17, 18, 19]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # applied before the shuffle as well


@pytest.mark.parametrize("n,percent", [(0, 5), (1, 5), (19, 5), (20, 5), (1000, 5), (1000, 100), (1000, 0)])
def test_split_percent_is_exact(spark, n, percent):
    rows = R.split_percent(spark.range(n), "id", percent).collect()
    assert len(rows) == n and sum(r["split"] == "validation" for r in rows) == n * percent // 100
    last = order(range(n))[n - n * percent // 100 :]
    assert {r.id for r in rows if r["split"] == "validation"} == set(last)


def test_split_percent_by_hash(spark):
    counts = {r["split"]: r["count"] for r in R.split_percent_by_hash(spark.range(20000), "id", 5).groupBy("split").count().collect()}
    assert 800 < counts["validation"] < 1200


def test_split_does_not_shuffle_rows(spark):
    df = R.split_exact(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id")
    main = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in main and "Window" not in main
