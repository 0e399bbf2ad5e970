"""Token ids, padding and label masks as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IGNORE_INDEX, PAD_TOKEN_ID, SPECIAL_TOKENS

# words first: they are most of a text, and no alternative starts like another
TOKEN_PATTERN = r"([^\s<]+|<\|[a-z_]+\|>|</?tool_call>|<)"


def split_tokens(text: Column) -> Column:
    """Special tokens stay whole; everything else splits at whitespace and ``<``."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 1)


def special_token_id(token: Column) -> Column:
    """Fixed id of a special token, null for any other string."""
    table = F.create_map(*[F.lit(x) for pair in SPECIAL_TOKENS.items() for x in pair])
    return F.try_element_at(table, token)


def token_id(token: Column) -> Column:
    """Fixed id for special tokens, else a hash below the first special id."""
    hashed = (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % PAD_TOKEN_ID).cast("int")
    return F.when(F.startswith(token, F.lit("<")), F.coalesce(special_token_id(token), hashed)).otherwise(hashed)


def encode(tokens: Column) -> Column:
    return F.transform(tokens, token_id)


def pad_to(ids: Column, length: Column | int, value: int) -> Column:
    """Exactly ``length`` entries: cut when longer, filled with ``value`` when shorter."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value), F.greatest(n - F.size(ids), F.lit(0)))), F.lit(1), n)


def attention_mask(ids: Column, length: Column | int) -> Column:
    """Ones over the kept tokens, zeros over the padding."""
    n = F.lit(length) if isinstance(length, int) else length
    kept = F.least(F.size(ids), n)
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), n - kept))


def mask_prefix(labels: Column, prefix: Column) -> Column:
    """First ``prefix`` entries ignored in the loss; ``prefix`` is at most the length."""
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), prefix), F.slice(labels, prefix + 1, F.size(labels) - prefix))


def mask_value(ids: Column, value: Column | int) -> Column:
    """Every occurrence of one id ignored in the loss."""
    target = F.lit(value) if isinstance(value, int) else value
    return F.transform(ids, lambda x: F.when(x == target, F.lit(IGNORE_INDEX)).otherwise(x))


def mask_tail(ids: Column, kept: Column) -> Column:
    """Only positions past the kept tokens ignored, so a real end-of-text keeps its label."""
    return F.concat(F.slice(ids, F.lit(1), kept), F.array_repeat(F.lit(IGNORE_INDEX), F.size(ids) - kept))


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")
