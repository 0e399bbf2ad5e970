"""Message arrays and their text renderings."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_SYSTEM_TEXT, IM_END, IM_START, TOOLS_FOOTER, TOOLS_HEADER


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_assistant(prompt: Column, answer: Column) -> Column:
    return F.array(message("user", prompt), message("assistant", answer))


def _part(kind: str, text: Column | None = None, image: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"),
        (text if text is not None else none).alias("text"),
        (image if image is not None else none).alias("image"),
    )


def vision_conversation(text: Column, caption: Column, image: Column) -> Column:
    """User turn of image and text, assistant turn of the caption."""
    return F.array(
        F.struct(
            F.lit("user").alias("role"),
            F.array(_part("image", image=image), _part("text", text=text)).alias("content"),
        ),
        F.struct(F.lit("assistant").alias("role"), F.array(_part("text", text=caption)).alias("content")),
    )


def flatten_messages(messages: Column) -> Column:
    """``role: text`` lines; the text parts of a message are joined by a space, messages without any are left out."""

    def texts(m: Column) -> Column:
        return F.filter(m["content"], lambda p: p["type"] == "text")

    with_text = F.filter(messages, lambda m: F.size(texts(m)) > 0)
    lines = F.transform(
        with_text,
        lambda m: F.concat(
            F.coalesce(m["role"], F.lit("")),
            F.lit(": "),
            F.array_join(F.transform(texts(m), lambda p: F.coalesce(p["text"], F.lit(""))), " "),
        ),
    )
    return F.array_join(lines, "\n")


def chatml_turn(role: Column, content: Column) -> Column:
    return F.concat(
        F.lit(IM_START), role, F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(IM_END + "\n")
    )


def chatml_header(first: Column, tools: list | None = None) -> Column:
    """System turn that opens every chat: the first message when it is one, else the default text."""
    text = F.when(
        first["role"] == "system", F.coalesce(first["content"], F.lit(""))
    ).otherwise(F.lit(DEFAULT_SYSTEM_TEXT))
    if not tools:
        return chatml_turn(F.lit("system"), text)
    # a tool is a JSON text, or an object dumped the way the chat template dumps it
    listed = "".join("\n" + (t if isinstance(t, str) else json.dumps(t, ensure_ascii=False)) for t in tools)
    return F.concat(F.lit(f"{IM_START}system\n"), text, F.lit(TOOLS_HEADER + listed + TOOLS_FOOTER))


def render_chatml(
    messages: Column, opens_chat: Column | None = None, generation_prompt: bool = False
) -> Column:
    """Message array to one ChatML string.

    ``opens_chat`` is false for a later part of a long chat: such a part has no header and
    its first message is rendered in place.
    """
    opens = F.lit(True) if opens_chat is None else opens_chat

    def turn(m: Column, i: Column) -> Column:
        shown = m["role"].isin("user", "assistant") | ((m["role"] == "system") & ~(opens & (i == 0)))
        return F.when(shown, chatml_turn(m["role"], m["content"])).otherwise(F.lit(""))

    body = F.array_join(F.transform(messages, turn), "")
    header = F.when(opens, chatml_header(F.get(messages, F.lit(0)))).otherwise(F.lit(""))
    text = F.concat(header, body)
    return with_generation_prompt(text) if generation_prompt else text


def render_chatml_tools(
    messages: Column, tools: list | None = None, generation_prompt: bool = False, call_form: str = "flat"
) -> Column:
    """ChatML with a tool list, assistant tool calls and grouped tool answers.

    Messages are ``struct<role, content, tool_calls: array<struct<name, arguments>>>`` where
    ``arguments`` is JSON text, so its key order is the source's. With ``call_form="function"`` a
    call is ``struct<function: struct<name, arguments>>``; with ``"either"`` it has all three fields and
    ``function`` wins where it is present.
    """
    if call_form not in ("flat", "function", "either"):
        raise ValueError(f"call_form must be flat, function or either, not {call_form!r}")

    def of(call: Column, field: str) -> Column:
        if call_form == "flat":
            return call[field]
        inner = call["function"][field]
        return inner if call_form == "function" else F.when(call["function"].isNotNull(), inner).otherwise(call[field])

    def calls(m: Column) -> Column:
        return F.array_join(
            F.transform(
                m["tool_calls"],
                lambda c: F.concat(
                    F.lit('\n<tool_call>\n{"name": "'), of(c, "name"),
                    F.lit('", "arguments": '), of(c, "arguments"), F.lit("}\n</tool_call>"),
                ),
            ),
            "",
        )

    def turn(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        has_calls = F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0
        before = F.get(messages, i - 1)["role"]
        after = F.get(messages, i + 1)["role"]
        opens_group = (i == 0) | (before != "tool") | before.isNull()
        closes_group = (after != "tool") | after.isNull()
        plain = (
            (m["role"] == "user")
            | ((m["role"] == "system") & (i > 0))
            | ((m["role"] == "assistant") & ~has_calls)
        )
        calling = F.concat(
            F.lit(f"{IM_START}assistant"),
            F.when(content != "", F.concat(F.lit("\n"), content)).otherwise(F.lit("")),
            calls(m),
            F.lit(IM_END + "\n"),
        )
        answering = F.concat(
            F.when(opens_group, F.lit(f"{IM_START}user")).otherwise(F.lit("")),
            F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"),
            F.when(closes_group, F.lit(IM_END + "\n")).otherwise(F.lit("")),
        )
        return (
            F.when(plain, chatml_turn(m["role"], content))
            .when(m["role"] == "assistant", calling)
            .when(m["role"] == "tool", answering)
            .otherwise(F.lit(""))
        )

    text = F.concat(
        chatml_header(F.get(messages, F.lit(0)), tools), F.array_join(F.transform(messages, turn), "")
    )
    return with_generation_prompt(text) if generation_prompt else text


def with_generation_prompt(text: Column) -> Column:
    return F.concat(text, F.lit(f"{IM_START}assistant\n"))
