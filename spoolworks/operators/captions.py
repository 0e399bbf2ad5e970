"""Caption lists, image existence and image file checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_IMAGE_INSTRUCTION
from ..functions.images import image_format, normalize_image_path, split_image_name
from ..functions.text import first_present


def explode_captions(df: DataFrame, captions: str, out: str = "caption", position: str | None = None) -> DataFrame:
    """One row per caption, with its place in the list as ``position``; a scalar is one row, an empty list none, a null caption stays one row."""
    kind = df.schema[captions].dataType
    if isinstance(kind, T.ArrayType):
        source = F.coalesce(F.col(captions), F.array(F.lit(None).cast(kind.elementType)))
    else:
        source = F.array(F.col(captions))
    rest = [c for c in df.columns if c not in (captions, out)]
    if position:
        return df.select(*rest, F.posexplode(source).alias(position, out))
    return df.select(*rest, F.explode(source).alias(out))


def first_caption(df: DataFrame, captions: str, out: str = "caption") -> DataFrame:
    """First of a list, or the scalar; rows with an empty list are left out."""
    if isinstance(df.schema[captions].dataType, T.ArrayType):
        kept = df.where(F.col(captions).isNull() | (F.size(captions) > 0))
        return kept.withColumn(out, F.get(captions, F.lit(0)))
    return df.withColumn(out, F.col(captions))


def _listing(files: DataFrame, path: str) -> DataFrame:
    return files.select(F.col(path).alias("__found"))


def semi_join_images(records: DataFrame, files: DataFrame, on: str = "image_path", file_path: str = "path") -> DataFrame:
    """Records whose image exists. Spark sizes the listing at run time and splits a hot path."""
    found = _listing(files, file_path)
    return records.join(found, F.col(on) == F.col("__found"), "left_semi")


def anti_join_missing(records: DataFrame, files: DataFrame, on: str = "image_path", file_path: str = "path") -> DataFrame:
    """Records whose image does not exist."""
    found = _listing(files, file_path)
    return records.join(found, F.col(on) == F.col("__found"), "left_anti")


def has_image_left_join(records: DataFrame, files: DataFrame, on: str = "image_path", file_path: str = "path") -> DataFrame:
    """All records, with ``has_image`` and the path only where the file exists."""
    found = _listing(files, file_path).distinct()
    return (
        records.join(found, F.col(on) == F.col("__found"), "left")
        .withColumn("has_image", F.col("__found").isNotNull())
        .withColumn("image", F.col("__found"))
        .drop("__found")
    )


def load_captions(
    records: DataFrame, files: DataFrame, image_dir: str, file_path: str = "path", keep: Sequence[str] = (), position: str | None = None
) -> DataFrame:
    """Caption records to ``image_path, text, caption`` rows of existing images.

    The existence join runs before captions are exploded, on the narrow side.
    """
    image = first_present(records, ["image", "image_path"], "")
    names = [n for n in ("output", "caption", "captions") if n in records.columns]
    text = first_present(records, ["instruction"], DEFAULT_IMAGE_INSTRUCTION)
    lists = [n for n in names if isinstance(records.schema[n].dataType, T.ArrayType)]
    if lists:
        none = F.lit(None).cast("array<string>")
        caption = F.coalesce(
            *[F.col(n) if n in lists else F.when(F.col(n).isNotNull(), F.array(n)).otherwise(none) for n in names],
            F.array(F.lit("")),
        )
    else:
        caption = first_present(records, names, "")
    rows = records.select(
        *keep,
        normalize_image_path(image, image_dir).alias("image_path"),
        text.alias("text"),
        caption.alias("captions"),
    )
    return explode_captions(semi_join_images(rows, files, file_path=file_path), "captions", position=position)


def valid_image(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose bytes start like an image file; the bytes become null first, then the row goes."""
    checked = df.withColumn(content, F.when(image_format(F.col(content)).isNotNull(), F.col(content)))
    return checked.where(F.col(content).isNotNull())


def whole_images(df: DataFrame, faults: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file has no fault among ``faults`` (``path, fault``); rows without an entry there go as well."""
    sound = faults.where("fault IS NULL").select(F.col("path").alias("__path"))
    return df.join(sound, F.col(path) == F.col("__path"), "left_semi")


def supported_image_type(df: DataFrame, kind: str, supported: tuple[str, ...] = ("path", "image")) -> DataFrame:
    return df.where(F.col(kind).isin(*supported))


def image_manifest(df: DataFrame, source: Column, split: str = "split", index: str = "index") -> DataFrame:
    """Source, target name and split of every image to copy."""
    return df.withColumns({"src": source, "dest": split_image_name(F.col(split), F.col(index))})
