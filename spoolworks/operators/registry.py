"""Caller-supplied functions: row maps, batch maps, predicates, formatters and batch hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

from . import projections as P

Formatter = Callable[[DataFrame], DataFrame]


def map_rows(df: DataFrame, remove_columns: bool = True, **columns: Column) -> DataFrame:
    """New columns from expressions, the old ones removed unless asked to stay."""
    made = [c.alias(name) for name, c in columns.items()]
    if remove_columns:
        return df.select(*made)
    return df.select(*[c for c in df.columns if c not in columns], *made)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int | None = None) -> DataFrame:
    """A pandas function over Arrow batches; ``workers`` sets the number of partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    source = df.repartition(workers) if workers else df
    return source.mapInPandas(run, schema)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


FORMATTERS: dict[str, Formatter] = {
    "conversation": P.vlm_conversation,
    "fixed_prompt": P.vlm_fixed_prompt,
    "inline_prompt": P.vlm_inline_prompt,
    "caption_only": P.vlm_caption_only,
}


def register_formatter(name: str, fn: Formatter) -> None:
    """Adds or overrides a formatter."""
    FORMATTERS[name] = fn


def formatter(model_type: str = "auto") -> Formatter:
    """Formatter of a model type; an unknown type gets the plain conversation."""
    return FORMATTERS.get(model_type, FORMATTERS["conversation"])


def batch_hook(*hooks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several per-batch hooks as one ``foreachBatch`` function, called in order."""

    def call(batch: DataFrame, number: int) -> None:
        for hook in hooks:
            hook(batch, number)

    return call
