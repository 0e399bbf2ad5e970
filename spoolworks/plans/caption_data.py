"""Caption records to splits and to training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_IMAGE_INSTRUCTION,
    MODEL_TURN_TEMPLATE,
    PAD_TOKEN_ID,
    SPLIT_JOB_CAPTION_FIELDS,
    SPLIT_JOB_CAPTION_HINTS,
    SPLIT_JOB_IMAGE_FIELDS,
    SPLIT_JOB_IMAGE_HINTS,
    USER_TURN_TEMPLATE,
)
from ..functions.chat import flatten_messages
from ..functions.images import normalize_image_path, split_image_name
from ..functions.text import first_present, is_empty
from ..operators import captions as C
from ..operators import projections as P
from ..operators import tokens as K
from ..operators.ranking import limit_first, sample_exact, split_exact_ranked
from ..sinks.files import read_heads


def flatten_caption_source(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``image, caption`` rows of a dataset whose field names are found by name or by hint."""
    fields = P.resolve_fields(
        df, SPLIT_JOB_IMAGE_FIELDS, SPLIT_JOB_IMAGE_HINTS, SPLIT_JOB_CAPTION_FIELDS, SPLIT_JOB_CAPTION_HINTS,
        on_multiple="last",
    )
    rows = df.select(*keep, F.col(fields["image"]).alias("image"), F.col(fields["caption"]).alias("caption"))
    return C.explode_captions(rows, "caption")


def split_caption_records(
    df: DataFrame, files: DataFrame, key: str, input_dir: str,
    sample_size: int = 0, val: float = 0.1, test: float = 0.1, seed: int = 42,
    instruction: str = DEFAULT_IMAGE_INSTRUCTION, file_path: str = "path",
) -> DataFrame:
    """Sample, split and number caption records, then keep those whose image exists.

    The index counts before the existence check, so names may have gaps. Result:
    ``key, split, index, instruction, output, image, src, dest``.
    """
    # keys alone are sampled, ranked and numbered; captions travel once, to the keys
    keys = df.select(key)
    keys = sample_exact(keys, sample_size, key, seed) if sample_size > 0 else keys
    numbered = split_exact_ranked(keys, key, val, test, seed).select(key, "split", "index")
    located = df.withColumn("src", normalize_image_path(F.col("image"), input_dir, "input_dir"))
    present = C.semi_join_images(located, files, "src", file_path).join(numbered, key)
    name = split_image_name(F.col("split"), F.col("index"))
    return present.select(
        key, "split", "index",
        first_present(df, ["instruction"], instruction).alias("instruction"),
        first_present(df, ["output", "caption"], "").alias("output"),
        F.concat(F.lit("images/"), name).alias("image"),
        "src",
        name.alias("dest"),
    )


def load_vision_records(
    records: DataFrame, files: DataFrame, image_dir: str, content: DataFrame | None = None,
    file_path: str = "path", keep: Sequence[str] = (),
    limit: int | None = None, order_key: str | None = None, limit_after_valid: bool = False, check_heads: bool = False,
) -> DataFrame:
    """Training rows of existing images; with ``content`` (path, content) or ``check_heads`` only those that decode.

    Existence comes first, so bytes of other files are never touched; ``check_heads`` opens the
    wanted files alone and reads their leading bytes. ``limit`` takes the first rows by ``order_key`` and the
    place of the caption in its record, before bytes are read unless ``limit_after_valid``.
    """
    if limit is not None and order_key is None:
        raise ValueError("a limit needs an order_key")
    P.detect_vision_format(records)
    place = "__place" if limit is not None else None
    names = list(dict.fromkeys([*keep, *([order_key] if limit is not None else [])]))
    rows = C.load_captions(records, files, image_dir, file_path, names, place)
    if limit is not None and not limit_after_valid:
        rows = limit_first(rows, limit, order_key, then=(place,))
    if content is not None:
        wanted = C.semi_join_images(content, rows.select("image_path"), file_path, "image_path")
        rows = _decodable(rows, C.valid_image(wanted).select(F.col(file_path).alias("__good")))
    if check_heads:
        heads = read_heads(rows, "image_path")
        rows = _decodable(rows, C.valid_image(heads, "head").select(F.col("path").alias("__good")))
    if limit is not None and limit_after_valid:
        rows = limit_first(rows, limit, order_key, then=(place,))
    return rows.drop("__place", *[n for n in names if n not in keep])


def _decodable(rows: DataFrame, good: DataFrame) -> DataFrame:
    return rows.join(good, F.col("image_path") == F.col("__good"), "left_semi")


def prepare_vision_prompts(
    records: DataFrame, files: DataFrame, image_dir: str | None = None,
    prompt_template: str = USER_TURN_TEMPLATE, response_template: str = MODEL_TURN_TEMPLATE,
    file_path: str = "path", keep: Sequence[str] = (), check_heads: bool = False,
) -> DataFrame:
    """Templated rows of all records; an image that is missing leaves ``has_image`` false.

    With ``check_heads`` so does a file that exists but does not start like an image.
    """
    image = F.col("image") if "image" in records.columns else F.lit(None).cast("string")
    stored = F.when(~is_empty(image), image)
    path = normalize_image_path(stored, image_dir, "joined") if image_dir is not None else stored
    located = records.withColumn("image_path", path)
    if check_heads:
        wanted = C.semi_join_images(files, located.select("image_path"), file_path, "image_path")
        files, file_path = C.valid_image(read_heads(wanted, file_path), "head"), "path"
    found = C.has_image_left_join(located, files, file_path=file_path)
    return P.format_template(found, prompt_template, response_template, keep)


def collate_vision(
    rows: DataFrame, max_length: int = 2048, batch: str = "batch_id", keep: Sequence[str] = (), pad_id: int = PAD_TOKEN_ID
) -> DataFrame:
    """Batches of vision rows as padded ids with labels; long rows are marked, not cut."""
    chats = P.vlm_conversation(rows, [batch, *keep])
    texts = chats.withColumn("text", flatten_messages(F.col("messages"))).drop("messages")
    padded = K.pad_to_batch_longest(K.tokenize(texts), batch, pad_id)
    return K.mask_pad_labels(K.flag_overlength(padded, max_length), pad_id)
