"""Rainfall index jobs over a grid and over requested points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garoa.functions import text as X
from garoa.operators import rain, spatial
from garoa.operators.sizing import broadcast_if_small, keep
from garoa.params import BBox, RainParams
from garoa.schemas import RESULT_INDEX


def _result_rows(long: DataFrame, execucao_id: Column, id_parts: list[str]) -> DataFrame:
    """Shape long index rows as the stored result table; ids follow the keys."""
    key = F.concat_ws("_", F.col("execucao_id"), *[F.col(p).cast("string") for p in id_parts])
    rows = long.withColumn("execucao_id", execucao_id).withColumn("id", key)
    for name in ("lat_input", "lon_input", "municipio_id"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_INDEX])


def wide_indices(grid: DataFrame, params: RainParams, bbox: BBox | None = None) -> DataFrame:
    """Unit rule, optional box, threshold and the eight indices, one row per cell and year.

    The box goes below the shuffle: the unit rule looks at the whole file, the
    threshold only at its own cell.
    """
    daily = rain.to_mm_day_by_file(grid)
    if bbox is not None:
        daily = rain.filter_grid_bbox(daily, bbox)
    daily = daily.select(*rain.CELL_YEAR, "t", "lat", "lon", "valor")
    return rain.annual_indices(rain.with_p95(daily, params), params)


def index_grid(
    grid: DataFrame,
    params: RainParams,
    execucao_id: Column,
    bbox: BBox | None = None,
    cell_map: DataFrame | None = None,
) -> DataFrame:
    """Long index results of every grid cell. ``execucao_id`` may use ``arquivo``.

    With a cell map the rows carry their municipality, joined on the yearly rows.
    """
    wide = wide_indices(grid, params, bbox)
    ids = ["arquivo", "iy", "ix", "lat", "lon", "ano"]
    if cell_map is not None:
        wide = spatial.enrich_with_municipality(wide, cell_map)
        ids.append("municipio_id")
    return _result_rows(rain.to_long(wide, ids), execucao_id, ["iy", "ix", "ano", "nome_indice"])


def index_points_wide(grid: DataFrame, points: DataFrame, params: RainParams) -> DataFrame:
    """Indices at the cell nearest to each point; needs ``ponto_id, lat, lon`` points.

    Only the series of cells that were hit is shuffled. Points that share a cell
    each get their own rows.
    """
    snapped = keep(spatial.snap_to_grid(points, spatial.grid_cells(grid)))
    daily = rain.to_mm_day_by_file(grid)
    hit = broadcast_if_small(snapped.select("iy", "ix").distinct())
    series = daily.join(hit, ["iy", "ix"], "left_semi").select(
        *rain.CELL_YEAR, "t", "lat", "lon", "valor"
    )
    wide = rain.annual_indices(rain.with_p95(series, params), params)
    asked = snapped.select(
        "ponto_id",
        F.col("lat").alias("lat_input"),
        F.col("lon").alias("lon_input"),
        "iy",
        "ix",
    )
    return asked.join(wide, ["iy", "ix"]).withColumnsRenamed({"lat": "lat_grid", "lon": "lon_grid"})


def index_points(
    grid: DataFrame, points: DataFrame, params: RainParams, execucao_id: Column
) -> DataFrame:
    """Long index results at points, with input and grid coordinates."""
    wide = index_points_wide(grid, points, params).withColumnsRenamed(
        {"lat_grid": "lat", "lon_grid": "lon"}
    )
    ids = ["ponto_id", "arquivo", "lat", "lon", "lat_input", "lon_input", "ano"]
    return _result_rows(
        rain.to_long(wide, ids), execucao_id, ["ponto_id", "arquivo", "ano", "nome_indice"]
    )


def scenario_of_run(from_file: Column, from_caller: str) -> Column:
    """Scenario of the file; the caller's label only where the file has none."""
    return F.when(from_file != X.UNKNOWN_SCENARIO, from_file).otherwise(F.lit(from_caller))


def run_summary(results: DataFrame) -> DataFrame:
    """Cells, years and rows of each stored run."""
    return results.groupBy("execucao_id").agg(
        F.countDistinct("lat", "lon").alias("total_celulas"),
        F.countDistinct("ano").alias("total_anos"),
        F.count(F.lit(1)).alias("total_resultados"),
    )


__all__ = [
    "index_grid",
    "index_points",
    "index_points_wide",
    "run_summary",
    "scenario_of_run",
    "wide_indices",
]
