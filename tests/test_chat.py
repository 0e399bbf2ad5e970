import pytest
from pyspark.sql import functions as F

from spoolworks import schemas
from spoolworks.constants import DEFAULT_SYSTEM_TEXT as SYSTEM
from spoolworks.functions import chat as H
from spoolworks.plans import turns as TT

CHAT = "messages array<struct<role:string,content:string>>"


def render(spark, chats, **options):
    df = spark.createDataFrame([(c,) for c in chats], CHAT)
    return [r[0] for r in df.select(H.render_chatml(F.col("messages"), **options)).collect()]


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_system_first_and_later(spark):
    got = render(spark, [
        [("system", "S"), ("user", "u"), ("assistant", "a")],
        [("user", "u"), ("system", "later"), ("assistant", "a")],
        [("user", "u"), ("critic", "dropped")],
    ])
    assert got == [
        turn("system", "S") + turn("user", "u") + turn("assistant", "a"),
        turn("system", SYSTEM) + turn("user", "u") + turn("system", "later") + turn("assistant", "a"),
        turn("system", SYSTEM) + turn("user", "u"),
    ]


def test_generation_prompt(spark):
    assert render(spark, [[("user", "u")]], generation_prompt=True)[0].endswith(turn("user", "u") + "<|im_start|>assistant\n")


def test_tools(spark):
    call = ("f", '{"x": 1}')
    block = '\n<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call>'
    tools = ['{"type": "function"}', '{"type": "other"}']
    listed = H.TOOLS_HEADER + '\n{"type": "function"}\n{"type": "other"}' + H.TOOLS_FOOTER
    default = f"<|im_start|>system\n{SYSTEM}{listed}"
    cases = [
        # two calls without text, two answers in one user turn
        (
            [("system", "S", None), ("user", "u", None), ("assistant", None, [call, call]),
             ("tool", "1", None), ("tool", "2", None), ("assistant", "done", None)],
            f"<|im_start|>system\nS{listed}" + turn("user", "u") + f"<|im_start|>assistant{block}{block}<|im_end|>\n"
            "<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n"
            + turn("assistant", "done"),
        ),
        # a call after text, an answer that ends the chat
        (
            [("user", "u", None), ("assistant", "text", [call]), ("tool", "1", None)],
            default + turn("user", "u") + f"<|im_start|>assistant\ntext{block}<|im_end|>\n"
            "<|im_start|>user\n<tool_response>\n1\n</tool_response><|im_end|>\n",
        ),
        # an answer that opens the chat, a later system turn in place
        (
            [("tool", "alone", None), ("user", "u", None), ("system", "later", None)],
            default + "<|im_start|>user\n<tool_response>\nalone\n</tool_response><|im_end|>\n" + turn("user", "u") + turn("system", "later"),
        ),
        # an empty call list is a plain turn
        ([("user", "u", None), ("assistant", "a", [])], default + turn("user", "u") + turn("assistant", "a")),
    ]
    kind = schemas.TOOL_MESSAGE.simpleString()
    df = spark.createDataFrame([(c,) for c, _ in cases], f"messages array<{kind}>")
    got = [r[0] for r in df.select(H.render_chatml_tools(F.col("messages"), tools)).collect()]
    assert got == [text for _, text in cases]


def test_flatten(spark):
    part = "struct<type:string,text:string,image:string>"
    rows = [([
        ("user", [("image", None, "p"), ("text", "a", None), ("text", "b", None)]),
        ("user", [("image", None, "p")]),
        ("assistant", [("text", "c", None)]),
    ],)]
    df = spark.createDataFrame(rows, f"messages array<struct<role:string,content:array<{part}>>>")
    assert df.select(H.flatten_messages(F.col("messages"))).first()[0] == "user: a b\nassistant: c"


def long_chats(spark):
    """One chat with most of the turns, one with gaps in its turn numbers."""
    hot = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2 == 0], f"t{i}") for i in range(300)]
    gaps = [(2, i, r, f"g{i}") for i, r in ((0, "user"), (70, "assistant"), (71, "user"), (200, "assistant"), (201, "user"))]
    return spark.createDataFrame(hot + gaps + [(3, 0, "user", "only")], "conv_id long, turn long, role string, text string")


def test_parts_do_not_change_pairs(spark):
    turns = long_chats(spark)
    whole = sorted(map(tuple, TT.question_answer_pairs(turns, 10_000).collect()))
    assert len(whole) == 149 + 2
    for size in (1, 7, 64):
        assert sorted(map(tuple, TT.question_answer_pairs(turns, size).collect())) == whole


def test_parts_join_to_the_whole_chat(spark):
    turns = long_chats(spark)

    def texts(size):
        return {r.conv_id: r.text for r in TT.render_turns(turns, size, generation_prompt=True).collect()}

    whole = texts(10_000)
    assert whole[3] == turn("system", SYSTEM) + turn("user", "only") + "<|im_start|>assistant\n"
    assert texts(7) == whole and texts(64) == whole
    messages = {r.conv_id: [m.content for m in r.messages] for r in TT.turns_to_messages(turns, 7).collect()}
    assert messages[2] == ["g0", "g70", "g71", "g200", "g201"] and messages[1] == [f"t{i}" for i in range(300)]


@pytest.mark.parametrize("n", [1024, 1025, 3000])
def test_chats_beyond_a_part_are_one_row(spark, n):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(n)] + [(2, 0, "user", "a"), (2, 1500, "assistant", "b"), (3, 5, "user", "one")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_messages for r in TT.min_turns(turns).collect()} == {1: n, 2: 2}
    assert sorted(map(tuple, TT.first_two_turns(turns).collect())) == [(1, "t0", "", "t1"), (2, "a", "", "b")]
    text = {r.conv_id: r.text for r in TT.render_turns(turns).collect()}
    assert text[1] == turn("system", SYSTEM) + "".join(turn(r, t) for _, _, r, t in rows[:n])
    assert text[2] == turn("system", SYSTEM) + turn("user", "a") + turn("assistant", "b")


def test_a_chat_too_large_for_a_record_is_named(spark):
    with pytest.raises(Exception, match="chat 1 has"):
        TT.render_turns(long_chats(spark), limit=100).collect()


def test_function_form_of_calls(spark):
    kind = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string,function:struct<name:string,arguments:string>>>>>"
    chat = [("user", "u", None), ("assistant", None, [(None, None, ("f", "{}")), ("g", "[]", None)])]
    text = spark.createDataFrame([(chat,)], f"messages {kind}").select(H.render_chatml_tools(F.col("messages"), call_form="either")).first()[0]
    assert '{"name": "f", "arguments": {}}' in text and '{"name": "g", "arguments": []}' in text
