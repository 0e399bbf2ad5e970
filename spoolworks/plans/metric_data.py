"""Run logs and metric tables to one tidy series table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.filters import metric_name_filter
from ..operators.metrics import unpivot_metrics
from ..sources.files import scan_run_logs


def metric_series(
    states: DataFrame | None = None, table: DataFrame | None = None, which: str = "all",
    ids: Sequence[str] = (), order_key: str | None = None, path: str | None = None,
) -> DataFrame:
    """``tag, step, value`` rows of trainer states or of a wide table, for any chart."""
    if states is not None:
        series = scan_run_logs(states, *(ids or ["run"])[:1], path=path)
    elif table is not None:
        series = unpivot_metrics(table, ids, order_key=order_key)
    else:
        raise ValueError("either trainer states or a metric table must be given")
    return metric_name_filter(series, which)
