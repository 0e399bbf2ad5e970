
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoolworks.constants import PAD_TOKEN_ID as PAD
from spoolworks.functions import tokens as TK
from spoolworks.operators import tokens as K
from spoolworks.plans.catalog import load
from spoolworks.plans.standins import Tables


def frame(spark, rows, schema="text string"):
    return spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)


def test_special_tokens_stay_whole(spark):
    df = frame(spark, ["<|im_start|>user\na<b <tool_call>x</tool_call><|im_end|>"])
    tokens = df.select(TK.split_tokens(F.col("text"))).first()[0]
    assert tokens == ["<|im_start|>", "user", "a", "<", "b", "<tool_call>", "x", "</tool_call>", "<|im_end|>"]
    found = [(r.position, r.token, r.id) for r in K.special_token_ids(df).collect()]
    assert found == [(0, "<|im_start|>", 151644), (5, "<tool_call>", 151657), (7, "</tool_call>", 151658), (8, "<|im_end|>", 151645)]


def test_pad_and_cut(spark):
    rows = K.tokenize_pad(frame(spark, ["a b", "a b c d e", "", "a b c"]), 3).collect()
    assert [len(r.input_ids) for r in rows] == [3] * 4
    assert [r.attention_mask for r in rows] == [[1, 1, 0], [1, 1, 1], [0, 0, 0], [1, 1, 1]]
    assert rows[0].input_ids[2] == PAD and rows[2].input_ids == [PAD] * 3


@pytest.mark.parametrize("prompt,masked", [("a", 1), ("a b c", 3), ("a b c d e f", 4), ("", 0)])
def test_prompt_mask(spark, prompt, masked):
    df = K.tokenize_pad(frame(spark, [("a b c", prompt)], "text string, prompt string"), 4)
    row = K.mask_prompt_labels(df).first()
    assert row.labels == [-100] * masked + row.input_ids[masked:]
    # padding after the prompt keeps its label unless asked
    strict = K.mask_prompt_labels(df, mask_pad=True).first()
    assert strict.labels[3] == -100


def test_pad_mask_and_real_end(spark):
    df = K.tokenize_pad(frame(spark, ["a <|endoftext|> b"]), 5)
    assert [i for i, x in enumerate(K.mask_pad_labels(df).first().labels) if x == -100] == [1, 3, 4]
    assert [i for i, x in enumerate(K.mask_pad_labels(df, mask_only_tail=True).first().labels) if x == -100] == [3, 4]


def test_batch_longest(spark):
    df = frame(spark, [(0, "a b c"), (0, "a"), (1, "a"), (1, "")], "batch_id long, text string")
    rows = K.pad_to_batch_longest(K.tokenize(df)).collect()
    assert sorted((r.batch_id, len(r.input_ids)) for r in rows) == [(0, 3), (0, 3), (1, 1), (1, 1)]
    rounded = K.pad_to_batch_longest(K.tokenize(df), multiple_of=8).collect()
    assert {len(r.input_ids) for r in rounded} == {8} and {len(r.attention_mask) for r in rounded} == {8}


def test_overlength_cuts_nothing(spark):
    rows = K.flag_overlength(K.tokenize(frame(spark, ["a b c", "a"])), 2).collect()
    assert [(len(r.input_ids), r.over_length) for r in rows] == [(3, True), (1, False)]


def test_default_pad(spark):
    df = frame(spark, [(None, 7), (3, 7)], "pad_token_id int, eos_token_id int")
    assert [r.pad_token_id for r in K.default_pad_token(df).collect()] == [7, 3]


@pytest.mark.parametrize("name,wide", [("pad_to_batch_longest", ("text", "input_ids")), ("split_caption_records", ("caption", "output", "text"))])
def test_wide_columns_cross_one_shuffle(spark, name, wide):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = load()[name].run(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan()
        moved, open_ = [], [plan]
        while open_:
            node = open_.pop()
            open_ += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                moved.append({node.output().apply(i).name() for i in range(node.output().size())} & set(wide))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # split_caption_records: one for the existence of the file, one for the split
    assert sum(map(bool, moved)) == (1 if name == "pad_to_batch_longest" else 2), moved


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab< |_im>\n", max_size=30), min_size=1, max_size=5), length=st.integers(1, 12))
def test_label_properties(spark, texts, length):
    rows = K.mask_pad_labels(K.tokenize_pad(frame(spark, texts), length)).collect()
    for r in rows:
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == length
        assert all(label == (-100 if token == PAD else token) for label, token in zip(r.labels, r.input_ids))
