"""Result tables, exports, the stored cell map and key checks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garoa.errors import DuplicateKeyError, ExportLimitError, ValidationError
from garoa.operators.rain import CELL
from garoa.operators.results import STRESS_ORDER

# Column order of a water-stress export.
EXPORT_COLUMNS = (
    "id",
    "execucao_id",
    "municipio_id",
    "nome_municipio",
    "uf",
    "ano",
    "cenario",
    "frequencia_dias_secos_quentes",
    "intensidade_mm_dia",
)
_PLAIN_ID = re.compile(r"[A-Za-z0-9_.\-]+")


def clustered(df: DataFrame) -> DataFrame:
    """Rows of a run together, sorted for row-group pruning."""
    keys = [c for c in ("ano", "nome_indice", "municipio_id") if c in df.columns]
    return df.sortWithinPartitions("execucao_id", *keys)


def write_results(df: DataFrame, path: str) -> None:
    """Append result rows, one folder per run, sorted for row-group pruning."""
    clustered(df).write.mode("append").partitionBy("execucao_id").parquet(path)


def replace_runs(df: DataFrame, path: str) -> None:
    """Replace the runs present in ``df`` and leave the others alone."""
    (
        clustered(df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("execucao_id")
        .parquet(path)
    )


def replace_run(df: DataFrame, path: str, run_id: str) -> None:
    """Replace one run, also when it now has no rows at all."""
    if not _PLAIN_ID.fullmatch(run_id):
        raise ValidationError(f"run id {run_id!r} cannot name a folder")
    own = clustered(df.filter(F.col("execucao_id") == run_id)).drop("execucao_id")
    own.write.mode("overwrite").parquet(f"{path}/execucao_id={run_id}")


def write_grid(df: DataFrame, table: str, buckets: int) -> None:
    """Store a grid as a table bucketed by cell and sorted by day.

    The index jobs hash by cell and file and sort by day, so on such a table
    they run without a shuffle. Rows are hashed the same way before the write:
    every task writes one file.
    """
    (
        df.repartition(buckets, *CELL)
        .write.mode("overwrite")
        .bucketBy(buckets, *CELL)
        .sortBy(*CELL, "ano", "t")
        .saveAsTable(table)
    )


def check_export_limit(df: DataFrame, max_rows: int) -> DataFrame:
    """Raise when a frame has more than ``max_rows`` rows (reads no more than needed)."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ExportLimitError(f"the export exceeds {max_rows} rows; narrow the filters")
    return df


def export_rows(df: DataFrame) -> DataFrame:
    """The export's columns and order."""
    return df.orderBy(*STRESS_ORDER).select(*EXPORT_COLUMNS)


def export_results(df: DataFrame, path: str, fmt: str = "csv", max_rows: int | None = None) -> None:
    """Write an export as CSV (NULL as an empty field) or as JSON objects, of any size unless limited."""
    if max_rows is not None:
        check_export_limit(df, max_rows)
    out = export_rows(df).write.mode("overwrite")
    if fmt == "csv":
        out.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "json":
        out.option("ignoreNullFields", False).json(path)
    else:
        raise ValidationError(f"unknown export format {fmt!r}")


def export_table_csv(df: DataFrame, path: str) -> None:
    """Any table as CSV, quoting where a value needs it."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def save_cell_map(cell_map: DataFrame, path: str, grid_id: str) -> None:
    """Store the cell map of a grid in its own folder."""
    if not _PLAIN_ID.fullmatch(grid_id):
        raise ValidationError(f"grid id {grid_id!r} cannot name a folder")
    cell_map.select("iy", "ix", "municipio_id").write.mode("overwrite").parquet(
        f"{path}/grid_id={grid_id}"
    )


def load_cell_map(spark: SparkSession, path: str, grid_id: str) -> DataFrame | None:
    """The stored cell map of a grid, or ``None``."""
    try:
        return spark.read.parquet(f"{path}/grid_id={grid_id}").withColumn("grid_id", F.lit(grid_id))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def cell_map_for(
    spark: SparkSession, path: str, grid_id: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Reuse the stored cell map of a grid, or build and store it once.

    Read back from storage it has a file size the planner can trust, so the
    spatial join is a broadcast exactly when the map is small.
    """
    stored = load_cell_map(spark, path, grid_id)
    if stored is None:
        save_cell_map(build(), path, grid_id)
        stored = load_cell_map(spark, path, grid_id)
    return stored


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise when a key repeats."""
    sample = duplicate_keys(df, keys).head(1)
    if sample:
        raise DuplicateKeyError(f"{keys} repeats, for example {sample[0].asDict()}")
    return df
