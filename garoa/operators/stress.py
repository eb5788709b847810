"""Municipality series and the dry-hot-day water-stress index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garoa.errors import GridReadError, NotFoundError
from garoa.functions import numeric as N
from garoa.functions import text as X
from garoa.operators.sizing import broadcast_if_small, detached
from garoa.params import StressParams

# The three climate variables.
VARIABLES = ("pr", "tas", "evspsbl")

_DAY_MICROS = 86_400_000_000

#: Files per time step from which all rows go through one exchange by cell.
CROWDED = 2

# Which of (pr, tas, evspsbl) a municipality is mapped in -> category.
DIVERGENCE = {
    (True, True, False): "em_pr_tas_mas_nao_evap",
    (True, False, True): "em_pr_evap_mas_nao_tas",
    (False, True, True): "em_tas_evap_mas_nao_pr",
    (True, False, False): "so_em_pr",
    (False, True, False): "so_em_tas",
    (False, False, True): "so_em_evap",
}


def canonical_units(grid: DataFrame) -> DataFrame:
    """mm/day for ``pr`` and ``evspsbl``, Celsius for ``tas``, by the unit text alone."""
    kind = N.column_type(grid, "valor")
    valor, units = F.col("valor"), F.col("units")
    tas = F.col("variavel") == "tas"
    water = F.col("variavel").isin("pr", "evspsbl")
    return grid.withColumn(
        "valor",
        F.when(tas, N.to_celsius(valor, units, kind))
        .when(water, N.to_mm_day(valor, units, kind))
        .otherwise(valor),
    ).withColumn("units", F.when(tas, F.lit("degC")).when(water, F.lit("mm/day")).otherwise(units))


def normalize_calendar(grid: DataFrame) -> DataFrame:
    """Turn ``cal_year, cal_month, cal_day[, cal_hour]`` into ``t``; dates that do not exist go."""
    hour = F.col("cal_hour") if "cal_hour" in grid.columns else None
    t = N.calendar_timestamp(F.col("cal_year"), F.col("cal_month"), F.col("cal_day"), hour)
    return grid.withColumn("t", t).filter(F.col("t").isNotNull())


def step_index(grid: DataFrame) -> DataFrame:
    """Which time steps each file has, as bitmaps of days: a small table that one narrow pass makes.

    A row per scenario, variable, file, time of day and 64 days, with
    ``dias``, the bits of its days, ``inicio``, ``fim`` and, where the grid knows
    the files' own scenarios, ``outro`` if that is another one. Bits are set before
    the shuffle, in numbers, so that nothing is sorted and a task sends six rows per
    file and year.
    """
    day = F.unix_date(F.col("t").cast("date")).cast("bigint")
    time = F.pmod(F.unix_micros(F.col("t").cast("timestamp")), F.lit(_DAY_MICROS)).alias("hora")
    own = F.col("cenario_arquivo") if "cenario_arquivo" in grid.columns else F.lit(None).cast("string")
    other = own.isNotNull() & (own != X.UNKNOWN_SCENARIO) & (own != F.col("cenario"))
    steps = grid.filter(F.col("t").isNotNull()).groupBy(
        "cenario", "variavel", "arquivo", time, F.shiftright(day, 6).alias("bloco")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(day, F.lit(64)).cast("int"))
    index = steps.agg(
        F.bit_or(bit).alias("dias"),
        F.min("t").alias("inicio"),
        F.max("t").alias("fim"),
        F.max(other).alias("outro"),
    )
    return detached(index)


def _united(index: DataFrame, *more: str) -> DataFrame:
    """Days of each scenario and variable: of all its files, and how many days the files have one by one."""
    return index.groupBy("cenario", "variavel", "hora", "bloco").agg(
        F.bit_or("dias").alias("dias"), F.sum(F.bit_count("dias")).alias("soma"), *[F.max(c).alias(c) for c in more]
    )


def common_steps(index: DataFrame) -> DataFrame:
    """``cenario, dias_comuns, outro``: time steps that all three variables share, by the bits they have in common."""
    three = _united(index, "outro").groupBy("cenario", "hora", "bloco").agg(
        F.bit_count(F.bit_and(F.when(F.col("variavel").isin(*VARIABLES), F.col("dias")))).alias("juntos"),
        F.count_if(F.col("variavel").isin(*VARIABLES)).alias("quantas"),
        F.max("outro").alias("outro"),
    )
    shared = F.when(F.col("quantas") == len(VARIABLES), F.col("juntos")).otherwise(0)
    return three.groupBy("cenario").agg(F.sum(shared).alias("dias_comuns"), F.max("outro").alias("outro"))


def contested_series(index: DataFrame) -> DataFrame:
    """Scenarios and variables of which two files have a time step: the files' days outnumber their union."""
    return _united(index).filter(F.col("soma") > F.bit_count("dias")).select("cenario", "variavel").distinct()


def contested_steps(index: DataFrame) -> DataFrame:
    """``cenario, variavel, t``: time steps that two files have; a bit's day is counted from ``inicio``, of the same time of day."""
    bits = index.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter(F.getbit("dias", "_bit") == 1)
    later = F.col("bloco") * 64 + F.col("_bit") - F.unix_date(F.col("inicio").cast("date"))
    t = F.col("inicio") + F.make_dt_interval(later.cast("int"))
    files = bits.groupBy("cenario", "variavel", t.alias("t")).agg(F.count("arquivo").alias("_files"))
    return files.filter(F.col("_files") > 1).select("cenario", "variavel", "t")


def files_per_step(index: DataFrame) -> float:
    """Files in which a time step of a series lies, on average."""
    [(held, steps)] = _united(index).agg(F.sum("soma"), F.sum(F.bit_count("dias"))).head(1)
    return held / steps if steps else 0.0


def _first_of_cells(grid: DataFrame, contested: DataFrame, index: DataFrame) -> DataFrame:
    """Grid rows but the copies of contested steps, by one exchange by cell that a join with a cell map finds in place.

    The files' names stay behind: their ranks, a number each, decide. A cell's rows
    lie in the order of steps and files, so that a copy follows a row of its step;
    the sort compares two integers first.
    """
    rank = F.row_number().over(Window.orderBy("arquivo")).alias("_file")
    files = broadcast_if_small(index.select("arquivo").filter(F.col("arquivo").isNotNull()).distinct().select("arquivo", rank))
    marked = grid.join(files, "arquivo", "left").join(contested, ["cenario", "variavel", "t"], "left")
    cell = ["iy", "ix", "variavel"]
    order = Window.partitionBy(*cell).orderBy("cenario", "t", F.coalesce("_file", F.lit(0)))
    dealt = marked.repartition(*cell).withColumns({"_c": F.lag("cenario").over(order), "_t": F.lag("t").over(order)})
    copy = F.col("_contested").isNotNull() & F.col("_c").eqNullSafe(F.col("cenario")) & F.col("_t").eqNullSafe(F.col("t"))
    return dealt.filter(~copy).select(*grid.columns)


def keep_first_file(grid: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Where files of one variable overlap in time, keep each cell's row of the first file.

    The bitmaps of ``step_index`` tell which series have an overlap. Without
    any, the grid is returned as it is; else they tell the time steps too, and
    only the rows of those are shuffled; the rank filter
    cuts copies before the shuffle. Where a step lies in ``CROWDED`` files or more
    on average, as in a folder whose files hold some cells of every day, most rows
    are contested, and all are dealt out by cell once.
    """
    index = step_index(grid) if index is None else index
    if contested_series(index).isEmpty():
        return grid
    step = ["cenario", "variavel", "t"]
    contested = broadcast_if_small(contested_steps(index).withColumn("_contested", F.lit(True)))
    if files_per_step(index) >= CROWDED:
        return _first_of_cells(grid, contested, index)
    copies = Window.partitionBy("cenario", "variavel", "iy", "ix", "t").orderBy("arquivo")
    firsts = (
        grid.join(contested, step, "left_semi")
        .withColumn("_n", F.row_number().over(copies))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )
    return grid.join(contested, step, "left_anti").select(*grid.columns).unionByName(
        firsts.select(*grid.columns)
    )


def place_in_municipality(grid: DataFrame, cell_map: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Grid rows of mapped cells with their municipality.

    The map has a row per cell, the grid one per cell and day: a map within the
    counted bound is broadcast and the grid stays where it was read.
    """
    ids = broadcast_if_small(cell_map.select(*on, "municipio_id"))
    return grid.join(ids, list(on))


def municipality_mean(
    grid: DataFrame, cell_map: DataFrame, on: tuple[str, ...] = ("iy", "ix")
) -> DataFrame:
    """Mean over the mapped cells of each municipality and time step, NaN skipped.

    A step whose cells are all NaN keeps a NULL row; municipalities without a
    cell are absent.
    """
    return place_in_municipality(grid, cell_map, on).groupBy("cenario", "variavel", "municipio_id", "t").agg(
        F.avg(N.finite_or_null(F.col("valor")).cast("double")).alias("valor")
    )


def filter_municipalities(series: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the municipalities of a target set."""
    return series.join(ids.select("municipio_id").distinct(), "municipio_id", "left_semi")


def series_of_municipality(
    grid: DataFrame, cell_map: DataFrame, municipio_id: int, on: tuple[str, ...] = ("iy", "ix")
) -> DataFrame:
    """Daily series of one municipality; raises when it has no mapped cell."""
    own = cell_map.filter(F.col("municipio_id") == municipio_id)
    if own.isEmpty():
        raise NotFoundError(f"municipality {municipio_id} is not mapped in this grid")
    return municipality_mean(grid, own, on).select("cenario", "variavel", "municipio_id", "t", "valor")


def common_times(*series: DataFrame) -> DataFrame:
    """Time steps present in every frame."""
    common = series[0].select("t").distinct()
    for other in series[1:]:
        common = common.join(other.select("t"), "t", "left_semi")
    return common


def common_municipalities(*maps: DataFrame) -> DataFrame:
    """Municipalities mapped in every grid."""
    common = maps[0].select("municipio_id").distinct()
    for other in maps[1:]:
        common = common.join(other.select("municipio_id"), "municipio_id", "left_semi")
    return common


def align_three(pr: DataFrame, tas: DataFrame, evap: DataFrame) -> DataFrame:
    """Municipality series side by side on the full time stamp; unmatched rows go."""
    keys = ["cenario", "municipio_id", "t"]

    def named(series: DataFrame, name: str) -> DataFrame:
        return series.select(*keys, F.col("valor").alias(name))

    return named(pr, "pr").join(named(tas, "tas"), keys).join(named(evap, "evap"), keys)


def municipality_days(
    grid: DataFrame, cell_map: DataFrame, on: tuple[str, ...] = ("variavel", "iy", "ix")
) -> DataFrame:
    """The three variables side by side per municipality and time step, in one aggregation.

    Equal to three spatial means followed by ``align_three``, with one shuffle
    and no join of large frames: a variable without a row for the step drops it.
    """
    placed = place_in_municipality(grid, cell_map, on)
    value = N.finite_or_null(F.col("valor")).cast("double")
    seen = [F.count_if(F.col("variavel") == v).alias(f"_n{i}") for i, v in enumerate(VARIABLES)]
    means = [
        F.avg(F.when(F.col("variavel") == v, value)).alias(name)
        for v, name in zip(VARIABLES, ("pr", "tas", "evap"), strict=True)
    ]
    days = placed.groupBy("cenario", "municipio_id", "t").agg(*means, *seen)
    return days.filter((F.col("_n0") > 0) & (F.col("_n1") > 0) & (F.col("_n2") > 0)).select(
        "cenario", "municipio_id", "t", "pr", "tas", "evap"
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when a frame is empty (runs a one-row job)."""
    if df.isEmpty():
        raise GridReadError(message)
    return df


def water_stress(days: DataFrame, params: StressParams) -> DataFrame:
    """Dry-hot days, their mean deficit (0 when none) and the total deficit per year.

    Days with a value missing do not count, but a year made only of such days
    keeps its row of zeros.
    """
    pr, tas, evap = F.col("pr"), F.col("tas"), F.col("evap")
    valid = N.valid_day(pr, tas, evap)
    hot = valid & N.is_dry_hot(pr, tas, params.limiar_pr_mm_dia, params.limiar_tas_c)
    deficit = N.daily_deficit(evap, pr)
    return (
        days.groupBy("cenario", "municipio_id", F.year("t").alias("ano"))
        .agg(
            F.count_if(F.coalesce(hot, F.lit(False))).cast("int").alias("dias_secos_quentes"),
            F.coalesce(F.avg(F.when(hot, deficit)), F.lit(0.0)).alias("intensidade_mm_dia"),
            F.coalesce(F.sum(F.when(valid, deficit)), F.lit(0.0)).alias("deficit_total_mm"),
        )
    )


def _mapped_in(cell_map: DataFrame) -> DataFrame:
    flags = [F.max(F.col("variavel") == v).alias(v) for v in VARIABLES]
    return cell_map.groupBy("municipio_id").agg(*flags)


def _category() -> Column:
    category = None
    for flags, name in DIVERGENCE.items():
        test = F.lit(True)
        for variable, present in zip(VARIABLES, flags, strict=True):
            test = test & (F.col(variable) == F.lit(present))
        category = (F if category is None else category).when(test, F.lit(name))
    return category


def divergence_report(cell_map: DataFrame, sample_ids: int = 10) -> DataFrame:
    """Municipalities not mapped in all three grids: count and smallest ids per category.

    ``cell_map`` has ``variavel, municipio_id``. The rank filter is pushed below
    the shuffle by the planner, so a category never gathers in one task.
    """
    odd = _mapped_in(cell_map).select("municipio_id", _category().alias("categoria")).filter(
        F.col("categoria").isNotNull()
    )
    ranked = Window.partitionBy("categoria").orderBy("municipio_id")
    sample = (
        odd.withColumn("n", F.row_number().over(ranked))
        .filter(F.col("n") <= sample_ids)
        .groupBy("categoria")
        .agg(F.sort_array(F.collect_list("municipio_id")).alias("amostra"))
    )
    totals = odd.groupBy("categoria").agg(F.count(F.lit(1)).alias("total"))
    return totals.join(sample, "categoria")


def divergence_totals(cell_map: DataFrame) -> DataFrame:
    """How many municipalities are processed and how many are left out."""
    every = F.col("pr") & F.col("tas") & F.col("evspsbl")
    return _mapped_in(cell_map).agg(
        F.count_if(~every).alias("total_pulados"), F.count_if(every).alias("total_processados")
    )


def time_span(grid: DataFrame) -> DataFrame:
    """First and last day and number of time steps of each variable."""
    index = step_index(grid)
    steps = index.groupBy("variavel", "hora", "bloco").agg(
        F.bit_count(F.bit_or("dias")).alias("n"), F.min("inicio").alias("inicio"), F.max("fim").alias("fim")
    )
    return steps.groupBy("variavel").agg(F.min("inicio").alias("inicio"), F.max("fim").alias("fim"), F.sum("n").alias("n"))
