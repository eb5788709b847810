"""Water-stress jobs: one scenario, or several in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garoa.errors import GridReadError
from garoa.operators import stress
from garoa.operators.sizing import listed, release
from garoa.params import StressParams
from garoa.schemas import WATER_STRESS
from garoa.sinks import tables
from garoa.sources.grid import read_three_folders

#: Scenarios of one batch, whose names become a filter of the scan.
MAX_SCENARIOS = 1_000


def stress_rows(indices: DataFrame, execucao_id: Column) -> DataFrame:
    """Shape yearly indices as the stored water-stress table."""
    rows = indices.select(
        "*",
        execucao_id.alias("execucao_id"),
        F.col("dias_secos_quentes").alias("frequencia_dias_secos_quentes"),
        F.current_timestamp().alias("criado_em"),
    )
    key = F.concat_ws("_", "execucao_id", F.col("municipio_id").cast("string"), F.col("ano").cast("string"))
    return rows.withColumn("id", key).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in WATER_STRESS]
    )


def dated(grid: DataFrame) -> DataFrame:
    """The grid with time steps of the common calendar; days that do not exist in it go."""
    if "cal_year" in grid.columns:
        own = grid.filter(F.col("cal_year").isNotNull())
        grid = stress.normalize_calendar(own).unionByName(grid.filter(F.col("cal_year").isNull()))
    return grid.filter(F.col("t").isNotNull())


def water_stress_days(
    grid: DataFrame,
    cell_map: DataFrame,
    on: tuple[str, ...] = ("variavel", "iy", "ix"),
    index: DataFrame | None = None,
) -> DataFrame:
    """Calendar, units, overlap rule, spatial means and alignment of a three-variable grid.

    ``index`` is the grid's step index, if it is known.
    """
    three = dated(grid.filter(F.col("variavel").isin(*stress.VARIABLES)))
    return stress.municipality_days(stress.keep_first_file(stress.canonical_units(three), index), cell_map, on)


def water_stress_run(
    grid: DataFrame,
    cell_map: DataFrame,
    params: StressParams,
    execucao_id: Column,
    on: tuple[str, ...] = ("variavel", "iy", "ix"),
) -> DataFrame:
    """Stored rows of one run over a grid that holds ``pr``, ``tas`` and ``evspsbl``.

    Raises when the three share no time step; that reads the time columns alone.
    """
    index = stress.step_index(dated(grid))
    stress.require_rows(stress.common_steps(index).filter("dias_comuns > 0"), "the three variables share no time step")
    return stress_rows(stress.water_stress(water_stress_days(grid, cell_map, on, index), params), execucao_id)


def scenario_checks(grid: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row per scenario: ``ok`` and the reason when its input cannot be used.

    A file whose own scenario (``cenario_arquivo``) is known and differs, or a
    scenario whose three variables share no time step, fails that scenario only.
    """
    verdict = stress.common_steps(stress.step_index(dated(grid)) if index is None else index)
    reason = F.when(F.col("outro"), F.lit("cenario_inconsistente")).when(
        F.col("dias_comuns") == 0, F.lit("intersecao_temporal_vazia")
    )
    return verdict.select("cenario", "dias_comuns", reason.alias("motivo"), reason.isNull().alias("ok"))


def water_stress_batch(
    grid: DataFrame,
    cell_map: DataFrame,
    params: StressParams,
    on: tuple[str, ...] = ("variavel", "iy", "ix"),
) -> tuple[DataFrame, DataFrame]:
    """All scenarios of ``grid`` in one plan: (results, one check row per scenario).

    One narrow pass indexes the time steps; it checks the scenarios and finds
    overlapping files. Rows of failed scenarios go where the grid is read.
    """
    index = stress.step_index(dated(grid))
    checks = scenario_checks(grid, index)
    usable = listed(checks.filter("ok").select("cenario"), MAX_SCENARIOS)
    if usable is None:
        raise ValueError(f"a batch has more than {MAX_SCENARIOS} scenarios")
    good = [r.cenario for r in usable]
    named = index.filter(F.col("cenario").isin(good)) if good else index.limit(0)
    kept = grid.filter(F.col("cenario").isin(good)) if good else grid.filter(F.lit(False))
    return stress.water_stress(water_stress_days(kept, cell_map, on, named), params), checks


def water_stress_from_folders(
    spark: SparkSession,
    folders: dict[str, dict[str, str]],
    cell_map: DataFrame,
    params: StressParams,
    path: str,
    on: tuple[str, ...] = ("variavel", "iy", "ix"),
    **given,
) -> tuple[DataFrame, DataFrame]:
    """Read, compute and replace one stored run per scenario: (one row per scenario, divergence report).

    ``folders`` has a folder per variable of each scenario. A folder that cannot
    be used fails its own scenario only and says why. Running again replaces the
    same runs.
    """
    states = []
    for cenario, three in folders.items():
        run_id, reason = f"estresse_{cenario}", None
        try:
            grid = read_three_folders(spark, three, cenario, **given)
            tables.replace_run(water_stress_run(grid, cell_map, params, F.lit(run_id), on), path, run_id)
        except GridReadError as error:
            reason = str(error)
        release()
        states.append((cenario, run_id, reason is None, reason))
    done = spark.createDataFrame(states, "cenario string, execucao_id string, ok boolean, motivo string")
    return done, stress.divergence_report(cell_map)


def stress_run_summary(rows: DataFrame) -> DataFrame:
    """Municipalities and rows of each stored run."""
    return rows.groupBy("execucao_id").agg(
        F.countDistinct("municipio_id").alias("municipios_processados"),
        F.count(F.lit(1)).alias("resultados_persistidos"),
    )
