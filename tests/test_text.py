from pyspark.sql import functions as F

from spoolworks.functions import text as X


def values(spark, rows, column, schema="s string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_strip_is_pythons(spark):
    rows = ["\t a\n ", "　x ", "a b", "", " \x1c\x85", "\x0bq\x0c"]
    assert values(spark, rows, X.strip(F.col("s"))) == [r.strip() for r in rows]


def test_blank_and_empty_differ(spark):
    rows = [None, "", " ", "\t\n", "x"]
    assert values(spark, rows, X.is_blank(F.col("s"))) == [True, True, True, True, False]
    assert values(spark, rows, X.is_empty(F.col("s"))) == [True, True, False, False, False]


def test_first_present_prefers_empty_over_null(spark):
    df = spark.createDataFrame([("", "c"), (None, "c"), (None, None)], "output string, caption string")
    got = [r[0] for r in df.select(X.first_present(df, ["output", "caption", "absent"], "d")).collect()]
    assert got == ["", "c", "d"]


def test_preview(spark):
    rows = ["a" * 200, "a" * 201, "ab"]
    assert values(spark, rows, X.preview(F.col("s"))) == ["a" * 200, "a" * 200 + "...", "ab"]
    assert values(spark, rows, X.preview(F.col("s"), 1, "never")) == ["a", "a", "a"]
    assert values(spark, ["ab"], X.preview(F.col("s"), 5, "always")) == ["ab..."]


def test_extract_answer(spark):
    rows = ["user q assistant\n yes ", "assistant a assistant b", "x assistant", "none here "]
    assert values(spark, rows, X.extract_answer(F.col("s"))) == ["yes", "b", "", "none here "]
    assert values(spark, ["PROMPT rest "], X.extract_answer(F.col("s"), prompt=F.lit("PROMPT"))) == ["rest"]
    assert values(spark, ["a ASSISTANT: b"], X.extract_answer(F.col("s"), "ASSISTANT:")) == ["b"]


def test_log_lines(spark):
    df = spark.createDataFrame([(2, 2.6389, None), (4, 2.0, "x")], "step long, loss double, note string")
    assert [r[0] for r in df.select(X.log_line(df, ["step", "loss", "note"])).collect()] == [
        "step: 2 - loss: 2.6389", "step: 4 - loss: 2.0000 - note: x",
    ]
    m = df.select(X.log_line_of_map(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(0.5)))).first()[0]
    assert m == "a: 1.0000 - b: 0.5000"


def test_clean_tag_and_rounding(spark):
    assert values(spark, ["train/loss/x"], X.clean_tag(F.col("s"))) == ["train_loss_x"]
    assert values(spark, [1.005, 2.345, -1.0], X.round_half_up(F.col("s")), "s double") == [1.0, 2.35, -1.0]
