"""Rainfall indices: unit rule, P95 threshold, annual indices, long form.

A grid is one row per file, cell and day, so a (file, cell, year) holds at most
366 rows and a cell's series as many days as the run has; every window below is
over such a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garoa.functions import numeric as N
from garoa.operators.sizing import broadcast_if_small
from garoa.params import BBox, RainParams, YearRange

# The cell indexes lead: the sort compares two integers before a file name.
CELL = ["iy", "ix", "arquivo"]
CELL_YEAR = [*CELL, "ano"]
INDEX_NAMES = list(N.INDEX_UNITS)
SMALL_MAX_MM = 5.0


def dataset_max(grid: DataFrame) -> DataFrame:
    """Largest value of every file, skipping NaN."""
    return grid.groupBy("arquivo").agg(F.max(N.nan_to_null(F.col("valor"))).alias("vmax"))


def to_mm_day_by_file(grid: DataFrame) -> DataFrame:
    """Convert files whose unit is a flux, or whose largest value is below 5.

    Only files without a flux unit are read for their maximum, and only those
    that fall below the mark, if any, are joined back.
    """
    kind = N.column_type(grid, "valor")
    flux = N.is_flux(F.col("units"))
    low = broadcast_if_small(
        dataset_max(grid.filter(~flux))
        .filter(F.col("vmax") < F.lit(SMALL_MAX_MM))
        .select("arquivo", F.lit(True).alias("_low"))
    )
    rows, convert = grid, flux
    if not low.isEmpty():
        rows = grid.join(low, "arquivo", "left")
        convert = flux | F.coalesce(F.col("_low"), F.lit(False))
    return (
        rows.withColumn("unidade_original", F.coalesce(F.col("units"), F.lit("")))
        .withColumn("conversao_unidade_aplicada", convert)
        .withColumn("valor", F.when(convert, N.per_day(F.col("valor"), kind)).otherwise(F.col("valor")))
        .withColumn("units", F.lit("mm/day"))
        .select(*grid.columns, "unidade_original", "conversao_unidade_aplicada")
    )


def filter_grid_bbox(grid: DataFrame, bbox: BBox) -> DataFrame:
    """Cells inside a box, longitudes brought to [-180, 180) first."""
    lon = N.normalize_lon(F.col("lon"), N.column_type(grid, "lon"))
    return grid.filter(N.in_bbox(F.col("lat"), lon, bbox))


def baseline_years(df: DataFrame, years: YearRange) -> DataFrame:
    """Rows of a closed interval of years."""
    return df.filter(F.col("ano").between(years.inicio, years.fim))


def _baseline_wet(params: RainParams, kind: str) -> Column:
    valor = F.col("valor")
    wet = ~F.isnan(valor) & (valor >= F.lit(params.p95_wet_thr).cast(kind))
    in_baseline = F.col("ano").between(params.baseline.inicio, params.baseline.fim)
    return F.when(in_baseline & wet, valor)


def p95_by_cell(grid: DataFrame, params: RainParams) -> DataFrame:
    """Exact 0.95 quantile of the wet baseline days of every cell.

    A cell without a wet baseline day gets NULL; without a baseline, all do.
    """
    kind = N.column_type(grid, "valor")
    if params.baseline is None:
        return grid.groupBy(*CELL).agg(F.lit(None).cast(kind).alias("p95"))
    quantile = F.percentile(_baseline_wet(params, kind), F.lit(0.95))
    return grid.groupBy(*CELL).agg(quantile.cast(kind).alias("p95"))


def attach_p95(grid: DataFrame, p95: DataFrame) -> DataFrame:
    """Left-join stored thresholds; a NaN threshold counts as none."""
    kind = N.column_type(p95, "p95")
    clean = p95.select(*CELL, N.finite_or_null(F.col("p95")).cast(kind).alias("p95"))
    return grid.join(clean, CELL, "left")


def with_p95(grid: DataFrame, params: RainParams) -> DataFrame:
    """Threshold of the cell on each of its rows, without a join.

    The window is sorted by year and day although the quantile needs no order:
    the five-day window then finds its rows hashed and sorted already, and one
    exchange and one sort serve the threshold, the moving sum and the yearly
    aggregation.
    """
    kind = N.column_type(grid, "valor")
    if params.baseline is None:
        return grid.withColumn("p95", F.lit(None).cast(kind))
    whole_cell = (
        Window.partitionBy(*CELL)
        .orderBy("ano", "t")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    quantile = F.percentile(_baseline_wet(params, kind), F.lit(0.95)).over(whole_cell)
    return grid.withColumn("p95", quantile.cast(kind))


def moving_sum_5(grid: DataFrame, value: Column) -> DataFrame:
    """Sum and size of the frame of five rows ending at each row of a year."""
    frame = Window.partitionBy(*CELL_YEAR).orderBy("t").rowsBetween(-4, Window.currentRow)
    return grid.withColumn("s5", F.sum(value.cast("double")).over(frame)).withColumn(
        "n5", F.count(F.lit(1)).over(frame)
    )


def annual_indices(grid: DataFrame, params: RainParams) -> DataFrame:
    """The eight indices of every (file, cell, year); expects a ``p95`` column.

    Inside a year with some finite value, the other days count as zero; a year
    with none has zero counts and NULL amounts.
    """
    kind = N.column_type(grid, "valor")
    x = F.col("x")
    thr, low, high = (
        F.lit(v).cast(kind) for v in (params.freq_thr_mm, *params.heavy_thresholds)
    )
    zero = F.lit(0.0).cast(kind)
    finite = N.is_finite(F.col("valor"))
    days = grid.withColumn("_ok", finite).withColumn("x", F.when(finite, F.col("valor")).otherwise(zero))
    sums = (
        moving_sum_5(days, x)
        .groupBy(*CELL_YEAR)
        .agg(
            F.max("lat").alias("lat"),
            F.max("lon").alias("lon"),
            F.max("_ok").alias("_any"),
            F.count_if(x >= thr).alias("_wet"),
            F.avg(F.when(x >= thr, x)).alias("_sdii"),
            F.max(x).alias("_rx1"),
            F.max(F.when(F.col("n5") == 5, F.col("s5"))).alias("_rx5"),
            F.count_if(x >= low).alias("_low"),
            F.count_if(x >= high).alias("_high"),
            F.max("p95").alias("p95"),
            F.sum(F.when(x > F.col("p95"), x).otherwise(zero).cast("double")).alias("_r95"),
            F.sum(x.cast("double")).alias("_tot"),
        )
    )
    some = F.col("_any")
    above = F.when(some & F.col("p95").isNotNull(), F.col("_r95"))

    def counted(name: str) -> Column:
        return F.when(some, F.col(name)).otherwise(F.lit(0)).cast("int")

    def amount(name: str) -> Column:
        return F.when(some, F.col(name).cast("double"))

    return sums.select(
        *CELL_YEAR,
        "lat",
        "lon",
        counted("_wet").alias("wet_days"),
        amount("_sdii").alias("sdii"),
        amount("_rx1").alias("rx1day"),
        amount("_rx5").alias("rx5day"),
        counted("_low").alias("r20mm"),
        counted("_high").alias("r50mm"),
        above.alias("r95ptot_mm"),
        F.when(F.col("_tot") > 0, above / F.col("_tot")).alias("r95ptot_frac"),
    )


def to_long(indices: DataFrame, ids: list[str]) -> DataFrame:
    """Eight rows per wide row, with the unit of each index."""
    values = [F.col(name).cast("double").alias(name) for name in INDEX_NAMES]
    return (
        indices.select(*ids, *values)
        .unpivot(ids, INDEX_NAMES, "nome_indice", "valor")
        .withColumn("unidade", N.index_unit(F.col("nome_indice")))
    )
