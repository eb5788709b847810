"""Daily grids from long or wide tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garoa.errors import (
    EmptyFolderError,
    GridReadError,
    InconsistentScenarioError,
    MissingVariableError,
)
from garoa.functions import numeric as N
from garoa.functions import text as X

# Accepted coordinate names, variables and attributes, in order of preference.
LAT_NAMES = ("lat", "latitude", "y")
LON_NAMES = ("lon", "longitude", "x")
MAIN_VARIABLES = ("pr", "tas", "evspsbl")
AUXILIARY = ("time_bnds", "time_bounds", "rotated_pole", "height", "lat_bnds", "lon_bnds")
SCENARIO_ATTRS = ("experiment_id", "scenario", "experiment")


def main_variable(columns: list[str]) -> str:
    """First column that is one of the three climate variables."""
    for name in columns:
        if name not in AUXILIARY and name in MAIN_VARIABLES:
            return name
    raise MissingVariableError(f"none of {MAIN_VARIABLES} among {columns}")


def _coordinates(columns: list[str]) -> tuple[str, str]:
    lat = next((c for c in LAT_NAMES if c in columns), None)
    lon = next((c for c in LON_NAMES if c in columns), None)
    if lat is None or lon is None:
        raise GridReadError(f"no latitude and longitude among {columns}")
    return lat, lon


def with_axis_index(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Add ``iy, ix`` as the ascending position of each coordinate on its axis.

    Only the distinct axis values, a few thousand at most, are ordered.
    """

    def axis(name: str, index: str) -> DataFrame:
        position = F.row_number().over(Window.orderBy(name)) - 1
        return df.select(name).distinct().select(name, position.cast("int").alias(index))

    return df.join(axis(lat, "iy"), lat).join(axis(lon, "ix"), lon)


def as_grid(
    df: DataFrame,
    variavel: str,
    arquivo: Column | None = None,
    cenario: Column | None = None,
    units: Column | None = None,
    calendario: Column | None = None,
    prefer: str = "name",
    kind: str | None = None,
) -> DataFrame:
    """Bring a long table (``valor``) or a wide one (a column per variable) to the grid schema.

    Missing columns fail here, without reading any data. The scenario comes from
    the file name and the attribute columns unless given. Calendars other than
    the common one bring ``cal_year, cal_month, cal_day[, cal_hour]`` instead of
    ``time``; their year is the calendar's own. A missing file name is empty.
    """
    columns = df.columns
    lat, lon = _coordinates(columns)
    if variavel in columns:
        rows, value = df, F.col(variavel)
    elif "valor" in columns and "variavel" in columns:
        rows, value = df.filter(F.col("variavel") == variavel), F.col("valor")
    else:
        raise MissingVariableError(f"variable {variavel!r} is not among {columns}")
    own_calendar = "cal_year" in columns
    time = next((c for c in ("t", "time") if c in columns), None)
    if time is None and not own_calendar:
        raise GridReadError(f"no time column among {columns}")
    if "iy" not in columns or "ix" not in columns:
        rows = with_axis_index(rows, lat, lon)

    def given(column: Column | None, name: str, default: Column) -> Column:
        if column is not None:
            return column
        return F.col(name) if name in columns else default

    name = F.coalesce(given(arquivo, "arquivo", F.lit("")), F.lit(""))
    attrs = [F.col(a) for a in SCENARIO_ATTRS if a in columns]
    guessed = X.infer_scenario(name, attrs, prefer)
    if time is None:
        hour = F.col("cal_hour") if "cal_hour" in columns else None
        t = N.calendar_timestamp(F.col("cal_year"), F.col("cal_month"), F.col("cal_day"), hour)
    else:
        t = F.col(time).cast("timestamp_ntz")
    year = F.col("cal_year").cast("int") if own_calendar else F.year(t)
    extra = [c for c in ("cal_year", "cal_month", "cal_day", "cal_hour") if c in columns]

    def number(column: Column) -> Column:
        return column if kind is None else column.cast(kind)

    return rows.select(
        given(cenario, "cenario", guessed).alias("cenario"),
        F.lit(variavel).alias("variavel"),
        name.alias("arquivo"),
        t.alias("t"),
        year.alias("ano"),
        F.col("iy").cast("int").alias("iy"),
        F.col("ix").cast("int").alias("ix"),
        number(F.col(lat)).alias("lat"),
        number(F.col(lon)).alias("lon"),
        number(value).alias("valor"),
        given(units, "units", F.lit("")).alias("units"),
        given(calendario, "calendario", F.lit("standard")).alias("calendario"),
        *extra,
    )


def _load(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_grid(
    spark: SparkSession,
    path: str,
    variavel: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    **given,
) -> DataFrame:
    """One variable of one table; the table's own name stands in for a missing ``arquivo``.

    A table may lie in many part files, and a cell's series in several of them.
    """
    df = _load(spark, path, fmt, schema)
    if "arquivo" not in df.columns:
        df = df.withColumn("arquivo", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
    return as_grid(df, variavel, **given)


def read_grid_folder(
    spark: SparkSession,
    folder: str,
    variavel: str,
    cenario: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    **given,
) -> DataFrame:
    """All files of a folder as one grid of the expected scenario.

    A file that names another scenario, by attribute first and by name second,
    is an error; one that names none is accepted. A folder whose only climate
    variable is another one is read all the same.
    """
    expected = cenario.strip().lower()
    try:
        df = _load(spark, folder, fmt, schema)
        seen = df.select(F.col("_metadata.file_name").alias("arquivo")).distinct()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise EmptyFolderError(f"no readable grid files in {folder}") from error
    df = df.withColumn("arquivo", F.col("_metadata.file_name"))
    attrs = [F.col(a) for a in SCENARIO_ATTRS if a in df.columns]
    own = X.infer_scenario(F.col("arquivo"), attrs, prefer="attrs")
    if attrs:
        labels = df.select("arquivo", own.alias("cenario"))
    else:
        labels = seen.select("arquivo", own.alias("cenario"))
    wrong = labels.filter(~F.col("cenario").isin(expected, X.UNKNOWN_SCENARIO)).head(1)
    if wrong:
        raise InconsistentScenarioError(f"{wrong[0]['arquivo']}: {wrong[0]['cenario']}, expected {expected}")
    if variavel not in df.columns and "valor" not in df.columns:
        variavel = main_variable(df.columns)
    return as_grid(df, variavel, cenario=F.lit(expected), prefer="attrs", **given)


def read_three_folders(
    spark: SparkSession, folders: dict[str, str], cenario: str, **given
) -> DataFrame:
    """The three variables of a scenario in one frame."""
    frames = [read_grid_folder(spark, folders[v], v, cenario, **given) for v in MAIN_VARIABLES]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
