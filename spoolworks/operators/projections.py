"""Raw records to the canonical shapes: field discovery, format detection, chat and prompt forms."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    CAPTION_FIELD_HINTS,
    CAPTION_FIELDS,
    CAPTION_SET,
    DEFAULT_IMAGE_INSTRUCTION,
    FIXED_IMAGE_PROMPT,
    IMAGE_FIELD_HINTS,
    IMAGE_FIELDS,
    INLINE_IMAGE_PROMPT,
    MODEL_TURN_TEMPLATE,
    USER_TURN_TEMPLATE,
)
from ..functions.chat import user_assistant, vision_conversation
from ..functions.images import kept_image_name, question_image_name
from ..functions.text import first_present, is_blank, is_empty
from .ranking import input_rank

# ---- schema mapping ---------------------------------------------------------------


def _plus(df: DataFrame, keep: Sequence[str], *columns: Column) -> DataFrame:
    return df.select(*keep, *columns)


def dolly_to_instruction(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _plus(
        df, keep,
        F.col("instruction"),
        first_present(df, ["context"], "").alias("input"),
        F.col("response").alias("output"),
    )


def min_messages(df: DataFrame, n: int = 2) -> DataFrame:
    return df.where(F.size("messages") >= n)


def chat_to_instruction(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """First two messages as instruction and output; shorter chats are left out."""
    return _plus(
        min_messages(df), keep,
        F.get("messages", F.lit(0))["content"].alias("instruction"),
        F.lit("").alias("input"),
        F.get("messages", F.lit(1))["content"].alias("output"),
    )


def qa_to_vlm(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Image questions to vision records; the file name is a hash pair."""
    name = question_image_name(F.col("question"), F.col("answer"))
    return _plus(
        df, keep,
        F.col("question").alias("instruction"),
        F.col("answer").alias("output"),
        F.concat(F.lit("images/"), name).alias("image"),
    )


# ---- plan-time field discovery -------------------------------------------------------


def resolve_field(
    columns: list[str], names: list[str], hints: list[str], on_multiple: str = "first"
) -> str | None:
    """Exact names in order, else a lower-cased substring match (``first`` or ``last`` wins)."""
    for name in names:
        if name in columns:
            return name
    matches = [c for c in columns if any(h in c.lower() for h in hints)]
    if not matches:
        return None
    return matches[0 if on_multiple == "first" else -1]


def resolve_fields(
    df: DataFrame,
    image_names: list[str] = IMAGE_FIELDS,
    image_hints: list[str] = IMAGE_FIELD_HINTS,
    caption_names: list[str] = CAPTION_FIELDS,
    caption_hints: list[str] = CAPTION_FIELD_HINTS,
    on_multiple: str = "first",
    required: bool = True,
) -> dict[str, str | None]:
    """Image and caption columns by schema alone.

    With ``last`` the two searches are coupled: when either exact name is missing, substring
    matches override both, and the last one wins.
    """
    columns = df.columns
    found = {
        "image": resolve_field(columns, image_names, image_hints, on_multiple),
        "caption": resolve_field(columns, caption_names, caption_hints, on_multiple),
    }
    if on_multiple == "last":
        exact = all(any(n in columns for n in names) for names in (image_names, caption_names))
        if not exact:
            for field, hints in (("image", image_hints), ("caption", caption_hints)):
                found[field] = resolve_field(columns, [], hints, "last") or found[field]
    if required and not all(found.values()):
        raise ValueError(f"no image and caption fields among {columns}")
    return found


def coalesce_fields(df: DataFrame, **targets: tuple[list[str], str | None]) -> DataFrame:
    """Adds each target column from the first non-null of its alternates, else a default."""
    return df.withColumns({t: first_present(df, names, default) for t, (names, default) in targets.items()})


def detect_format(df: DataFrame, strict: bool = False) -> str:
    """``dolly``, ``alpaca``, ``chat`` or ``simple``, from the column names."""
    columns = set(df.columns)
    fits = [
        name
        for name, needed in (
            ("dolly", {"instruction", "response"}),
            ("alpaca", {"instruction", "output"}),
            ("chat", {"messages"}),
        )
        if needed <= columns
    ]
    if strict and len(fits) > 1:
        raise ValueError(f"columns fit several formats: {fits}")
    return fits[0] if fits else "simple"


def detect_vision_format(df: DataFrame) -> str:
    if {"image", "image_path", "caption", "captions"} & set(df.columns):
        return "captions"
    raise ValueError(f"no vision format fits the columns {df.columns}")


def detect_format_per_row(df: DataFrame) -> Column:
    """The same choice row by row, for sources that mix formats."""

    def has(*names: str) -> Column:
        test = F.lit(all(n in df.columns for n in names))
        for n in names:
            if n in df.columns:
                test = test & F.col(n).isNotNull()
        return test

    return (
        F.when(has("instruction", "response"), "dolly")
        .when(has("instruction", "output"), "alpaca")
        .when(has("messages"), "chat")
        .otherwise("simple")
    )


# ---- text formats ---------------------------------------------------------------------


def _with_context(df: DataFrame, extra: str, label: str) -> Column:
    instruction = first_present(df, ["instruction"], "")
    context = first_present(df, [extra], "")
    return F.when(is_empty(context), instruction).otherwise(
        F.concat(instruction, F.lit(f"\n\n{label}: "), context)
    )


def format_dolly(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    prompt = _with_context(df, "context", "Context")
    return _plus(df, keep, user_assistant(prompt, first_present(df, ["response"], "")).alias("messages"))


def format_alpaca(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    prompt = _with_context(df, "input", "Input")
    return _plus(df, keep, user_assistant(prompt, first_present(df, ["output"], "")).alias("messages"))


def format_simple(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _plus(
        df, keep,
        user_assistant(
            first_present(df, ["instruction", "text"], ""), first_present(df, ["response", "output"], "")
        ).alias("messages"),
    )


def to_chat(df: DataFrame, keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Whatever the detected format, ``messages`` out."""
    kind = detect_format(df, strict)
    if kind == "chat":
        return df.select(*keep, "messages")
    return {"dolly": format_dolly, "alpaca": format_alpaca, "simple": format_simple}[kind](df, keep)


def format_gemma_turns(df: DataFrame, include_input: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Turn markup around instruction and input; a blank input is left out."""
    user = F.col("instruction")
    if include_input and "input" in df.columns:
        user = F.when(is_blank(F.col("input")), user).otherwise(F.concat(user, F.lit("\n"), F.col("input")))
    prompt = fill_template(USER_TURN_TEMPLATE, instruction=user)
    response = fill_template(MODEL_TURN_TEMPLATE, output=F.col("output"))
    return _plus(
        df, keep,
        F.concat(prompt, response).alias("text"), prompt.alias("prompt"), response.alias("response"),
    )


def fill_template(template: str, **fields: Column) -> Column:
    """A format string over columns, taken apart once on the driver."""
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if spec or conversion or name not in fields:
                raise ValueError(f"unsupported placeholder {name!r} in template")
            parts.append(F.coalesce(fields[name], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def format_template(
    df: DataFrame,
    prompt_template: str = USER_TURN_TEMPLATE,
    response_template: str = MODEL_TURN_TEMPLATE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """User templates over ``{instruction}`` and ``{output}``, with ``has_image`` and the image path."""
    prompt = fill_template(
        prompt_template, instruction=first_present(df, ["instruction"], DEFAULT_IMAGE_INSTRUCTION)
    )
    response = fill_template(response_template, output=first_present(df, ["output", "caption"], ""))
    image = F.col("image") if "image" in df.columns else F.lit(None).cast("string")
    has_image = ~is_empty(image)
    return _plus(
        df, keep,
        F.concat(prompt, response).alias("text"), prompt.alias("prompt"), response.alias("response"),
        has_image.alias("has_image"), F.when(has_image, image).alias("image"),
    )


# ---- vision formats --------------------------------------------------------------------


def vlm_conversation(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    image = F.col("image") if "image" in df.columns else F.lit(None).cast("string")
    return _plus(
        df, keep,
        vision_conversation(first_present(df, ["text"], ""), first_present(df, ["caption"], ""), image).alias("messages"),
    )


def vlm_fixed_prompt(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _plus(
        df, keep, vision_conversation(F.lit(FIXED_IMAGE_PROMPT), F.col("text"), F.col("image")).alias("messages")
    )


def vlm_inline_prompt(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _plus(df, keep, F.concat(F.lit(INLINE_IMAGE_PROMPT), F.col("text")).alias("text"))


def vlm_caption_only(df: DataFrame, strict_reference: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The caption alone as training text.

    The trainers looked only at ``caption`` and ``text`` while the split job writes ``output``,
    which emptied every caption; ``strict_reference`` keeps that for comparison.
    """
    names = ["caption", "text"] if strict_reference else ["output", "caption", "captions", "text"]
    usable = [n for n in names if n in df.columns and isinstance(df.schema[n].dataType, T.StringType)]
    return _plus(df, keep, first_present(df, usable, "").alias("text"))


def caption_to_vlm(df: DataFrame, order_key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Any caption dataset to vision records; the shape is chosen from the schema.

    Numbered names count kept rows in ``order_key`` order.
    """
    columns = set(df.columns)
    number = F.col("__n").cast("string")
    numbered = F.concat(F.lit(f"{CAPTION_SET}_"), number, F.lit(".jpg"))
    if "feature" in columns:
        rows = input_rank(df, order_key, name="__n")
        image_id = F.col("img_id").cast("string") if "img_id" in columns else F.concat(F.lit("feature_"), number)
        named = next((F.col(c) for c in ("caption", "sent") if c in columns), None)
        caption = named if named is not None else F.concat(F.lit("Image "), image_id, F.lit(" description"))
        name = numbered
    elif {"sentence1", "sentence2"} <= columns:
        rows = input_rank(df, order_key, name="__n")
        caption, name = F.col("sentence1"), numbered
    else:
        rows = fill_or_drop(df, order_key)
        caption, name = F.col("__caption"), kept_image_name(F.col("__image"), F.col("__n"))
    return rows.select(
        *keep,
        F.lit(DEFAULT_IMAGE_INSTRUCTION).alias("instruction"),
        caption.alias("output"),
        F.concat(F.lit("images/"), name).alias("image"),
    )


def fill_or_drop(df: DataFrame, order_key: str) -> DataFrame:
    """Rows with neither image nor caption go; one missing side gets a numbered stand-in.

    Adds ``__image``, ``__caption`` and ``__n`` (count of kept rows before).
    """
    fields = resolve_fields(df, required=False)
    image = F.col(fields["image"]) if fields["image"] else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    usable = F.lit(True)
    if fields["caption"] is None:
        caption = none
    elif isinstance(df.schema[fields["caption"]].dataType, T.ArrayType):
        # an empty caption list is a failed row, not a missing caption
        caption = F.get(fields["caption"], F.lit(0))
        usable = F.col(fields["caption"]).isNull() | (F.size(fields["caption"]) > 0)
    else:
        caption = F.col(fields["caption"])
    kept = (
        df.withColumns({"__image": image, "__caption": caption})
        .where(usable & (F.col("__image").isNotNull() | F.col("__caption").isNotNull()))
    )
    number = F.col("__n").cast("string")
    return input_rank(kept, order_key, name="__n").withColumns({
        "__image": F.coalesce(F.col("__image"), F.concat(F.lit(f"{CAPTION_SET}_"), number, F.lit(".jpg"))),
        "__caption": F.coalesce(
            F.col("__caption"), F.concat(F.lit("Image "), number, F.lit(" without a description"))
        ),
    })
