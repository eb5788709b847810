"""User queries over stored results: list, count, aggregate, export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from garoa.operators import results as R
from garoa.params import Aggregation, Page, ResultFilter, StressFilter
from garoa.sinks import tables


def query_results(
    results: DataFrame,
    f: ResultFilter,
    p: Page,
    runs: DataFrame | None = None,
    municipalities: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(one page, total) of filtered index results."""
    rows = R.filter_results(results, f, runs, municipalities)
    return R.page(rows, R.RESULT_ORDER, p), R.count_rows(rows)


def query_stress(
    stress: DataFrame, f: StressFilter, p: Page, municipalities: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(one page with names, total) of filtered water-stress results."""
    rows = R.filter_stress(stress, f, municipalities)
    named = R.stress_with_municipality(rows, municipalities)
    return R.page(named, R.STRESS_ORDER, p), R.count_rows(rows)


def aggregate(
    results: DataFrame,
    agg: Aggregation,
    f: ResultFilter = ResultFilter(),
    runs: DataFrame | None = None,
    municipalities: DataFrame | None = None,
) -> DataFrame:
    """Aggregated groups in ascending key order."""
    out = R.aggregate_results(results, agg, f, runs, municipalities)
    return out.orderBy(*agg.dimensoes) if agg.dimensoes else out


def export_stress(
    stress: DataFrame,
    municipalities: DataFrame,
    f: StressFilter,
    path: str,
    fmt: str = "csv",
    max_rows: int | None = None,
) -> None:
    """Write filtered water-stress results in the fixed column order."""
    rows = R.stress_with_municipality(R.filter_stress(stress, f, municipalities), municipalities)
    tables.export_results(rows, path, fmt, max_rows)
