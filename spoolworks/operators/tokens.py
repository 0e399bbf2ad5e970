"""Tokenising, padding and label masks over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PAD_TOKEN_ID
from ..functions import tokens as K
from ..session import spread


def tokenize(df: DataFrame, text: str = "text", out: str = "input_ids", partitions: int | None = None) -> DataFrame:
    """Unpadded ids of the whole text by the built-in token rule.

    Hashing takes far longer than reading, and a reader cannot cut a row group: ``partitions`` deals rows of
    few large groups to so many tasks first.
    """
    return spread(df, partitions).withColumn(out, K.encode(K.split_tokens(F.col(text))))


def pad_to_length(df: DataFrame, length: int, pad_id: int = PAD_TOKEN_ID, ids: str = "input_ids") -> DataFrame:
    """Ids and mask, both exactly ``length`` long."""
    raw = F.col(ids)
    return df.withColumns({
        ids: K.pad_to(raw, length, pad_id),
        "attention_mask": K.attention_mask(raw, length),
    })


def tokenize_pad(df: DataFrame, length: int, text: str = "text", pad_id: int = PAD_TOKEN_ID, partitions: int | None = None) -> DataFrame:
    """Ids and mask of exactly ``length`` entries; tokens past the cut are never hashed. ``partitions`` is as in ``tokenize``."""
    cut = F.slice(K.split_tokens(F.col(text)), 1, length)
    return pad_to_length(spread(df, partitions).withColumn("input_ids", K.encode(cut)), length, pad_id)


def mask_prompt_labels(
    df: DataFrame, prompt: str = "prompt", prompt_ids: str | None = None,
    mask_pad: bool = False, pad_id: int = PAD_TOKEN_ID,
) -> DataFrame:
    """``labels``: ids with the prompt's tokens ignored. Padding keeps its id unless ``mask_pad``.

    ``prompt_ids`` names the prompt's own ids when a caller's tokenizer made them.
    """
    ids = F.col("input_ids")
    length = F.size(prompt_ids) if prompt_ids else F.size(K.split_tokens(F.col(prompt)))
    # a column of its own, so that the prompt is split once per row
    counted = df.withColumn("__prompt", F.least(length, F.size(ids)))
    labels = K.mask_prefix(ids, F.col("__prompt"))
    if mask_pad:
        labels = K.mask_value(labels, pad_id)
    return counted.withColumn("labels", labels).drop("__prompt")


def mask_pad_labels(df: DataFrame, pad_id: int = PAD_TOKEN_ID, mask_only_tail: bool = False) -> DataFrame:
    """``labels``: ids with padding ignored.

    When padding borrows the end-of-text id, real ends are ignored too, unless
    ``mask_only_tail`` goes by the attention mask.
    """
    ids = F.col("input_ids")
    if mask_only_tail:
        kept = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
        counted = df.withColumn("__kept", kept)
        return counted.withColumn("labels", K.mask_tail(ids, F.col("__kept"))).drop("__kept")
    return df.withColumn("labels", K.mask_value(ids, pad_id))


def batch_lengths(sizes: DataFrame, batch: str = "batch_id", size: str = "n_tokens", multiple_of: int | None = None) -> DataFrame:
    """``batch, padded_length``: the longest row of each batch, a maximum that combines before the shuffle."""
    longest = F.max(size)
    return sizes.groupBy(batch).agg((K.round_up(longest, multiple_of) if multiple_of else longest).alias("padded_length"))


def pad_to_column(df: DataFrame, target: str = "padded_length", pad_id: int = PAD_TOKEN_ID) -> DataFrame:
    """Ids and mask as long as a column says, nothing cut."""
    raw = F.col("input_ids")
    return df.withColumns({
        "attention_mask": K.attention_mask(raw, F.col(target)),
        "input_ids": K.pad_to(raw, F.col(target), pad_id),
    })


def pad_to_batch_longest(
    df: DataFrame, batch: str = "batch_id", pad_id: int = PAD_TOKEN_ID, multiple_of: int | None = None
) -> DataFrame:
    """Pads each batch to its longest row, nothing cut; a batch is a bounded group by construction.

    Only sizes are aggregated; the rows meet their batch's length in one join.
    """
    lengths = batch_lengths(df.select(batch, F.size("input_ids").alias("n_tokens")), batch, multiple_of=multiple_of)
    return pad_to_column(df.join(lengths, batch), pad_id=pad_id)


def flag_overlength(df: DataFrame, length: int, ids: str = "input_ids") -> DataFrame:
    """Marks rows longer than ``length``; nothing is cut."""
    return df.withColumn("over_length", F.size(ids) > length)


def default_pad_token(config: DataFrame, pad: str = "pad_token_id", eos: str = "eos_token_id") -> DataFrame:
    return config.withColumn(pad, F.coalesce(pad, eos))


def special_token_ids(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per special token in the text, with its position among all tokens and fixed id.

    Tokens are filtered with their positions in place; only the special ones become rows.
    """
    rest = [c for c in df.columns if c != text]
    placed = F.transform(K.split_tokens(F.col(text)), lambda t, i: F.struct(i.alias("position"), t.alias("token"), K.special_token_id(t).alias("id")))
    hits = F.filter(placed, lambda p: p["id"].isNotNull())
    return df.select(*rest, F.explode(hits).alias("__hit")).select(*rest, "__hit.position", "__hit.token", "__hit.id")


def joined(ids: Column) -> Column:
    """Array as one printable string."""
    return F.array_join(ids.cast("array<string>"), " ")
