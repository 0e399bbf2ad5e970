import pytest
from pyspark.sql import functions as F

from spoolworks.operators import projections as P
from spoolworks.plans import caption_data as CD
from spoolworks.plans import text_data as TD


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_detect_format(spark):
    def kind(columns, **options):
        return P.detect_format(frame(spark, ", ".join(f"{c} string" for c in columns)), **options)

    assert kind(["instruction", "response"]) == "dolly"
    assert kind(["instruction", "output"]) == "alpaca"
    assert kind(["instruction", "output", "response"]) == "dolly"
    assert kind(["messages"]) == "chat"
    assert kind(["text"]) == "simple"
    with pytest.raises(ValueError):
        kind(["instruction", "output", "messages"], strict=True)
    assert P.detect_vision_format(frame(spark, "captions string")) == "captions"
    with pytest.raises(ValueError):
        P.detect_vision_format(frame(spark, "text string"))


def test_format_per_row(spark):
    df = frame(spark, "instruction string, response string, output string", ("i", "r", None), ("i", None, "o"), (None, None, "o"))
    assert [r[0] for r in df.select(P.detect_format_per_row(df)).collect()] == ["dolly", "alpaca", "simple"]


def prompts(df):
    return [r[0][0]["content"] for r in df.collect()]


def test_context_rules(spark):
    dolly = frame(spark, "instruction string, context string, response string", ("i", None, "r"), ("i", "", "r"), ("i", " ", "r"), ("i", "c", "r"))
    assert prompts(P.format_dolly(dolly)) == ["i", "i", "i\n\nContext:  ", "i\n\nContext: c"]
    alpaca = frame(spark, "instruction string, input string, output string", ("i", " ", "o"), ("i", "x", None))
    rows = P.to_chat(alpaca).collect()
    assert rows[0][0][0]["content"] == "i\n\nInput:  "
    assert rows[1][0][1]["content"] == ""
    simple = frame(spark, "text string, output string", ("t", "o"))
    assert [tuple(m) for m in P.to_chat(simple).first()[0]] == [("user", "t"), ("assistant", "o")]


def test_turn_markup_drops_blank_input(spark):
    df = frame(spark, "instruction string, input string, output string", *[("i", x, "o") for x in (None, "", " ", "\t\n", "x")])
    plain = "<start_of_turn>user\ni<end_of_turn>\n<start_of_turn>model\n"
    got = [r.prompt for r in P.format_gemma_turns(df).collect()]
    assert got == [plain] * 4 + ["<start_of_turn>user\ni\nx<end_of_turn>\n<start_of_turn>model\n"]
    assert {r.prompt for r in P.format_gemma_turns(df, include_input=False).collect()} == {plain}
    assert P.format_gemma_turns(df).first().text == plain + "o<end_of_turn>"


def test_templates(spark):
    df = frame(spark, "instruction string, caption string, image string", ("i", "c", "p.jpg"), (None, "c", ""), ("i", None, None))
    rows = P.format_template(df, "Q{{{instruction}}}:", "A {output}").collect()
    assert [(r.prompt, r.response, r.has_image, r.image) for r in rows] == [
        ("Q{i}:", "A c", True, "p.jpg"), ("Q{Describe this image in detail.}:", "A c", False, None), ("Q{i}:", "A ", False, None),
    ]
    with pytest.raises(ValueError):
        P.fill_template("{nope}", instruction=F.lit(""))


def test_resolve_fields(spark):
    df = frame(spark, "photo_a string, my_image string, Text1 string, description string, text2 string")
    assert P.resolve_fields(df) == {"image": "photo_a", "caption": "Text1"}
    assert P.resolve_fields(df, on_multiple="last") == {"image": "my_image", "caption": "text2"}
    # an exact name is overridden when the other side needs the search
    mixed = frame(spark, "image string, image_2 string, text_x string")
    last = P.resolve_fields(mixed, ["image"], ["image"], ["caption"], ["text"], on_multiple="last")
    assert last == {"image": "image_2", "caption": "text_x"}
    with pytest.raises(ValueError):
        P.resolve_fields(frame(spark, "a string, b string"))


def test_fill_or_drop(spark):
    df = frame(spark, "id long, img string, captions array<string>",
               (1, "a/b.png", ["x", "y"]), (2, None, None), (3, None, ["z"]), (4, "c.gif", None), (5, "d.jpg", []))
    rows = [tuple(r) for r in P.caption_to_vlm(df, "id", ["id"]).orderBy("id").collect()]
    say = "Describe this image in detail."
    assert rows == [
        (1, say, "x", "images/b.png"), (3, say, "z", "images/flickr8k_1.jpg"),
        (4, say, "Image 2 without a description", "images/flickr8k_2.jpg"),
    ]


def test_feature_and_pair_sources(spark):
    features = frame(spark, "id long, feature int, img_id string, sent string", (1, 0, "k", "s"))
    assert tuple(P.caption_to_vlm(features, "id").first()) == ("Describe this image in detail.", "s", "images/flickr8k_0.jpg")
    bare = frame(spark, "id long, feature int, img_id string", (1, 0, "k"))
    assert P.caption_to_vlm(bare, "id").first().output == "Image k description"
    pairs = frame(spark, "id long, sentence1 string, sentence2 string", (1, "a", "b"))
    assert P.caption_to_vlm(pairs, "id").first().output == "a"


def test_first_two_messages(spark):
    df = frame(spark, "messages array<struct<role:string,content:string>>", ([("user", "q"), ("assistant", "a"), ("user", "x")],), ([("user", "q")],))
    assert [tuple(r) for r in P.chat_to_instruction(df).collect()] == [("q", "", "a")]


def test_caption_only_modes(spark):
    df = frame(spark, "output string, image string", ("kept", "p"))
    assert P.vlm_caption_only(df).first().text == "kept"
    assert P.vlm_caption_only(df, strict_reference=True).first().text == ""


def test_chat_tokens_and_instruction_tokens(spark):
    df = frame(spark, "id long, instruction string, input string, output string", (1, "a b", "", "c"), (2, "a b", "d", "e f"))
    for rows in (TD.prepare_chat_tokens(df, 40, keep=["id"]), TD.prepare_instruction_tokens(df, 40, keep=["id"])):
        for r in rows.collect():
            assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 40
            assert all(label in (-100, token) for label, token in zip(r.labels, r.input_ids))
    with_tools = TD.prepare_chat_tokens(df, 400, tools=[{"name": "f"}], keep=["id"])
    assert 151657 in with_tools.first().input_ids


def test_flatten_caption_source(spark):
    df = frame(spark, "id long, images string, caption array<string>", (1, "p", ["a", "b"]), (2, "q", []))
    assert sorted(map(tuple, CD.flatten_caption_source(df, ["id"]).collect())) == [(1, "p", "a"), (1, "p", "b")]
