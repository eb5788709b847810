"""Every registered query next to its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.bindings import with_views
from checks.compare import connect, differences
from checks.registry import ORACLES, QUERIES

#: Queries whose answer must vary for the comparison to prove anything, and columns in which it does.
VARIED = {
    "water_stress": ("dias_secos_quentes", "intensidade_mm_dia", "deficit_total_mm"),
    "water_stress_with_gaps": ("dias_secos_quentes", "intensidade_mm_dia"),
    "water_stress_360_day": ("dias_secos_quentes", "intensidade_mm_dia"),
    "water_stress_from_folders": ("frequencia_dias_secos_quentes", "intensidade_mm_dia"),
    "water_stress_job": ("frequencia_dias_secos_quentes", "intensidade_mm_dia"),
    "water_stress_batch": ("dias_secos_quentes", "intensidade_mm_dia"),
    "stress_with_municipality": ("frequencia_dias_secos_quentes", "intensidade_mm_dia"),
    "filter_stress": ("frequencia_dias_secos_quentes", "intensidade_mm_dia"),
    "page_stress": ("frequencia_dias_secos_quentes", "intensidade_mm_dia"),
    "yearly_mean_frequency": ("frequencia_media",),
    "dry_hot_days": ("seco_quente", "deficit"),
    "filter_suppliers": ("nome",),
    "page_suppliers": ("nome", "cidade", "uf"),
    "new_suppliers": ("nome", "numero_linha"),
    "import_suppliers": ("status", "motivo"),
    "import_suppliers_of_two_files": ("status", "motivo"),
    "locate_points_in_overlapping_features": ("municipio_id", "encontrado"),
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in plan
    assert differences(df, con, ORACLES[name]) is None
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", VARIED)
def test_answers_vary(name):
    rows = connect("/root/testdata/sf0.01")
    for column in VARIED[name]:
        assert rows.execute(f"SELECT count(DISTINCT {column}) FROM ({ORACLES[name]})").fetchall()[0][0] > 1


def test_bound_results_have_missing_values():
    rows = connect("/root/testdata/sf0.01")
    sql = with_views("SELECT count(*) FILTER (WHERE valor IS NULL), count(valor) FROM results", "results")
    missing, held = rows.execute(sql).fetchall()[0]
    assert missing > 0 and held > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "id"
