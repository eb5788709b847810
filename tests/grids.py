"""Small grids made from seeded recipes."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import functions as F


def _long(values, lat2d, lon2d, **columns):
    nt, ny, nx = values.shape
    it, iy, ix = np.indices(values.shape)
    out = pd.DataFrame(
        {
            "iy": iy.ravel().astype("int32"),
            "ix": ix.ravel().astype("int32"),
            "lat": np.broadcast_to(lat2d, values.shape).ravel(),
            "lon": np.broadcast_to(lon2d, values.shape).ravel(),
            "valor": values.ravel(),
        }
    )
    for name, per_day in columns.items():
        out[name] = np.asarray(per_day)[it.ravel()]
    return out


def basic_grid(spark):
    """Five years on a 10x10 grid, flux units."""
    lat = np.linspace(-23.0, -20.0, 10, dtype=np.float32)
    lon = np.linspace(-47.0, -44.0, 10, dtype=np.float32)
    lon2d, lat2d = np.meshgrid(lon, lat)
    days = pd.date_range("2026-01-01", "2030-12-31")
    values = np.random.default_rng(seed=42).uniform(0.0, 2.5e-4, size=(len(days), 10, 10))
    pdf = _long(values.astype(np.float32), lat2d, lon2d, t=days, ano=days.year.astype("int32"))
    return finish(spark.createDataFrame(pdf), "pr_rcp45_basic.nc", "kg m-2 s-1")


def grid_360(spark):
    """Three 360-day years on a 5x5 grid, mm/day."""
    lat = np.linspace(-10.0, -5.0, 5, dtype=np.float32)
    lon = np.linspace(-60.0, -55.0, 5, dtype=np.float32)
    lon2d, lat2d = np.meshgrid(lon, lat)
    n = np.arange(1080)
    values = np.random.default_rng(seed=7).uniform(0.0, 40.0, size=(1080, 5, 5)).astype(np.float32)
    # The single-variable path needs the calendar's year and an order of days only.
    pdf = _long(
        values, lat2d, lon2d, t=pd.Timestamp("2026-01-01") + pd.to_timedelta(n, unit="D"),
        ano=(2026 + n // 360).astype("int32"),
    )
    return finish(spark.createDataFrame(pdf), "pr_360_rcp85.nc", "mm/day")


def finish(df, arquivo, units, variavel="pr", cenario="rcp45"):
    return df.select(
        F.lit(cenario).alias("cenario"), F.lit(variavel).alias("variavel"),
        F.lit(arquivo).alias("arquivo"), F.col("t").cast("timestamp_ntz").alias("t"), "ano",
        "iy", "ix", F.col("lat").cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"),
        F.col("valor").cast("float").alias("valor"), F.lit(units).alias("units"),
        F.lit("standard").alias("calendario"),
    )


def long_grid(spark, values, lat, lon, start, arquivo, units, variavel, cenario="rcp45"):
    """A small dense array as a grid table."""
    lon2d, lat2d = np.meshgrid(np.asarray(lon, dtype=np.float32), np.asarray(lat, dtype=np.float32))
    days = pd.date_range(start, periods=values.shape[0])
    pdf = _long(np.asarray(values, dtype=np.float32), lat2d, lon2d, t=days, ano=days.year.astype("int32"))
    return finish(spark.createDataFrame(pdf), arquivo, units, variavel, cenario)
