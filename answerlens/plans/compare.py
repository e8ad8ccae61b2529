"""Comparing history: items over reports, movers, entrants, categories, two dates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from answerlens.operators import trends as T
from answerlens.operators.scale import materialize


def trend_report(metrics: DataFrame, start=None, end=None, n: int = 10) -> dict[str, DataFrame]:
    """All lists of the trend report; the item history is written once and read by each."""
    history = materialize(T.item_history(metrics, start, end))
    return {
        "history": history,
        "movers": T.top_movers(history, n),
        "entrants_leavers": T.entrants_leavers(history, metrics, n),
        "categories": T.category_summary(history),
    }


def compare(metrics: DataFrame, first, second, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(all differences, first ``k`` per section and status) between two dates."""
    rows = T.compare_dates(metrics, first, second)
    return rows, T.compare_summary(rows, k)
