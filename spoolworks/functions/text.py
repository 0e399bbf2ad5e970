"""String predicates and formatting shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import STRIP_CHARS


def strip(text: Column) -> Column:
    """Trim both ends of everything Python calls whitespace (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def is_empty(text: Column) -> Column:
    """True for null and empty text; whitespace counts as content."""
    return F.coalesce(text, F.lit("")) == ""


def first_present(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    """First non-null of the columns that exist, in order, else the default. An empty string wins."""
    found = [F.col(name) for name in names if name in df.columns]
    if default is not None:
        found.append(F.lit(default))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def preview(text: Column, size: int = 200, ellipsis: str = "when_cut") -> Column:
    """First ``size`` characters; ``...`` follows ``when_cut``, ``always`` or ``never``."""
    head = F.substring(text, 1, size)
    if ellipsis == "never":
        return head
    if ellipsis == "always":
        return F.concat(head, F.lit("..."))
    if ellipsis == "when_cut":
        return F.when(F.length(text) > size, F.concat(head, F.lit("..."))).otherwise(text)
    raise ValueError(f"ellipsis must be when_cut, always or never, not {ellipsis!r}")


def clean_tag(tag: Column) -> Column:
    """Metric tag with slashes made underscores."""
    return F.translate(tag, "/", "_")


def extract_answer(text: Column, marker: str = "assistant", prompt: Column | None = None) -> Column:
    """Stripped text after the last marker. Without a marker the prompt length is cut, or all is kept."""
    answer = strip(F.substring_index(text, marker, -1))
    if prompt is None:
        fallback = text
    else:
        fallback = strip(F.substr(text, F.length(prompt) + 1))
    return F.when(F.contains(text, F.lit(marker)), answer).otherwise(fallback)


def log_line_of_map(metrics: Column) -> Column:
    """``name: 0.0000`` pairs of a map<string,double>, joined by `` - ``."""
    return F.array_join(
        F.transform(F.map_entries(metrics), lambda e: F.format_string("%s: %.4f", e["key"], e["value"])), " - "
    )


def log_line(df: DataFrame, names: list[str]) -> Column:
    """As above over columns: fractions get four places, the rest print as is, nulls are left out."""
    parts = []
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            shown = F.format_string("%.4f", F.col(name))
        else:
            shown = F.col(name).cast("string")
        parts.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}: "), shown)))
    return F.array_join(F.array(*parts), " - ")


def round_half_up(value: Column, places: int = 2) -> Column:
    """Rounding that engines agree on: floor of the scaled value plus one half."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale
