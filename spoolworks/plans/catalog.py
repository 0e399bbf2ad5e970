"""Registry of runnable queries, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .standins import Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query; ``views`` are prepended to its SQL as a WITH list."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = f"WITH {', '.join(views)} {sql}" if sql and views else sql
        QUERIES[name] = Query(fn, text)
        return fn

    return add


def load() -> dict[str, Query]:
    from . import queries_images, queries_io, queries_metrics, queries_sampling, queries_streams, queries_text  # noqa: F401

    return QUERIES


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: q.run(Tables(spark, folder))

    return {name: bind(q) for name, q in load().items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in load().items() if q.sql}
