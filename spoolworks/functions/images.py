"""Image paths, generated names and file signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CAPTION_SET, IMAGE_SUFFIXES


def normalize_image_path(path: Column, image_dir: str, rule: str = "loader") -> Column:
    """Stored image path to the path that is opened.

    ``loader``    one leading ``images/`` removed, then joined to the folder unless absolute
    ``trainer``   the same with a plain join, so an empty path gives the folder and a slash
    ``joined``    joined as it stands unless absolute
    ``input_dir`` joined only when it starts with ``images/``
    """
    base = image_dir.rstrip("/")
    if rule == "input_dir":
        return F.when(F.startswith(path, F.lit("images/")), F.concat(F.lit(base + "/"), path)).otherwise(path)
    if rule in ("loader", "trainer"):
        path = F.regexp_replace(path, "^images/", "")
    elif rule != "joined":
        raise ValueError(f"unknown path rule {rule!r}")
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base + "/"), path))
    if rule == "loader":
        return F.when(path == "", F.lit(base)).otherwise(joined)
    return joined


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def split_image_name(split: Column, index: Column) -> Column:
    return F.format_string("%s_%05d.jpg", split, index)


def kept_image_name(path: Column, index: Column) -> Column:
    """Own file name when it has an image suffix, else a numbered one."""
    name = base_name(path)
    known = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        known = known | F.endswith(name, F.lit(suffix))
    return F.when(known, name).otherwise(F.concat(F.lit(f"{CAPTION_SET}_"), index.cast("string"), F.lit(".jpg")))


def question_image_name(question: Column, answer: Column) -> Column:
    return F.concat(F.md5(question), F.lit("_"), F.md5(answer), F.lit(".jpg"))


def image_format(content: Column) -> Column:
    """Format named by the leading bytes of a file, null when none is known."""

    def starts(hexes: str, at: int = 1) -> Column:
        raw = bytes.fromhex(hexes)
        return F.substring(content, at, len(raw)) == F.lit(raw)

    return (
        F.when(starts("ffd8ff"), "jpeg")
        .when(starts("89504e470d0a1a0a"), "png")
        .when(starts("474946383761") | starts("474946383961"), "gif")
        .when(starts("424d"), "bmp")
        .when(starts("52494646") & starts("57454250", 9), "webp")
        .when(starts("49492a00") | starts("4d4d002a"), "tiff")
    )
