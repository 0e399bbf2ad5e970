"""Text records to token rows: detect, format, render, tokenise, pad, mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PAD_TOKEN_ID
from ..functions.chat import render_chatml, render_chatml_tools
from ..operators import projections as P
from ..operators import tokens as K
from ..operators.ranking import sample_exact


def instruction_records(df: DataFrame, n: int, key: str, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """A seeded sample of chats or of instruction records in the canonical three columns."""
    sample = sample_exact(df, n, key, seed)
    return P.chat_to_instruction(sample, keep) if "messages" in df.columns else P.dolly_to_instruction(sample, keep)


def prepare_chat_tokens(
    df: DataFrame, length: int = 2048, tools: list | None = None,
    pad_id: int = PAD_TOKEN_ID, keep: Sequence[str] = (),
) -> DataFrame:
    """Any supported text format to ``input_ids, attention_mask, labels``; one pass, no shuffle."""
    chats = P.to_chat(df, keep)
    if tools:
        fields = chats.schema["messages"].dataType.elementType.names
        if "tool_calls" not in fields:
            none = F.lit(None).cast("array<struct<name:string,arguments:string>>")
            chats = chats.withColumn(
                "messages", F.transform("messages", lambda m: m.withField("tool_calls", none))
            )
        text = render_chatml_tools(F.col("messages"), tools)
    else:
        text = render_chatml(F.col("messages"))
    rows = chats.select(*keep, text.alias("text"))
    tokens = K.tokenize_pad(rows, length, pad_id=pad_id)
    return K.mask_pad_labels(tokens, pad_id).select(*keep, "input_ids", "attention_mask", "labels")


def prepare_instruction_tokens(
    df: DataFrame, length: int = 2048, include_input: bool = True,
    pad_id: int = PAD_TOKEN_ID, keep: Sequence[str] = (),
) -> DataFrame:
    """Instruction records to turn markup and tokens with the prompt ignored in the loss."""
    rows = P.format_gemma_turns(df, include_input, keep)
    return K.mask_prompt_labels(K.tokenize_pad(rows, length, pad_id=pad_id))
