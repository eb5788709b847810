"""One local session for all tests; its checkpoint folder is a fresh temporary one."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("garoa-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "checkpoint"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def basic(spark, tmp_path_factory):
    from grids import basic_grid

    path = str(tmp_path_factory.mktemp("grid") / "basic")
    basic_grid(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def calendar_360(spark, tmp_path_factory):
    from grids import grid_360

    path = str(tmp_path_factory.mktemp("grid") / "g360")
    grid_360(spark).write.parquet(path)
    return spark.read.parquet(path)
