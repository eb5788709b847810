"""Rainfall indices against frozen answers and a plain numpy computation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from grids import finish, long_grid
from pyspark.sql import functions as F

from garoa.errors import ValidationError
from garoa.operators import rain, spatial
from garoa.params import BBox, RainParams, YearRange
from garoa.plans import rain_jobs

POINTS = [("A", -22.9, -46.5), ("B", -22.0, -45.5), ("C", -21.5, -44.8), ("D", -20.8, -44.2), ("E", -23.0, -47.0)]
NAMES = rain.INDEX_NAMES

# Expected answers (year -> the eight indices) at point A of each grid.
BASIC_A = {
    2026: (35, 20.845550537109375, 21.53835678100586, 89.35346984863281, 35, 0, 486.46466064453125, 0.1244388474476306),
    2027: (27, 20.931175231933594, 21.594600677490234, 91.00123596191406, 27, 0, 360.5106201171875, 0.0897237502927951),
    2028: (31, 20.881080627441406, 21.598905563354492, 90.64167785644531, 31, 0, 381.82574462890625, 0.09433637594363022),
    2029: (30, 20.815509796142578, 21.526060104370117, 93.62591552734375, 30, 0, 400.95941162109375, 0.09876994465122296),
    2030: (24, 20.74064064025879, 21.56475257873535, 92.55812072753906, 24, 0, 211.82276916503906, 0.05310432866234117),
}
CALENDAR_360_A = {
    2026: (172, 29.856115341186523, 39.87979507446289, 167.52430725097656, 172, 0, 623.3242797851562, 0.08847096203935441),
    2027: (164, 30.051990509033203, 39.99614334106445, 176.98106384277344, 164, 0, 745.5150756835938, 0.10736382022177993),
    2028: (169, 29.533775329589844, 39.946533203125, 173.0259552001953, 169, 0, 701.3427734375, 0.10184744970114419),
}


def points(spark):
    return spark.createDataFrame(POINTS, "ponto_id string, lat double, lon double")


def brute(series, params, p95):
    """The eight indices of one year of values."""
    arr = np.asarray(series, dtype=np.float64)
    ok = np.isfinite(arr)
    if not ok.any():
        return (0, None, None, None, 0, 0, None, None)
    x = np.where(ok, arr, 0.0)
    wet = x[x >= params.freq_thr_mm]
    five = [x[i : i + 5].sum() for i in range(len(x) - 4)]
    low, high = params.heavy_thresholds
    r95 = None if p95 is None else x[x > p95].sum()
    frac = None if p95 is None or x.sum() <= 0 else r95 / x.sum()
    return (len(wet), wet.mean() if len(wet) else None, x.max(), max(five) if five else None,
            int((x >= low).sum()), int((x >= high).sum()), r95, frac)


def same(got, want, rel=1e-6):
    for g, w in zip(got, want, strict=True):
        if w is None or g is None:
            assert g is None and w is None, (got, want)
        else:
            assert math.isclose(g, w, rel_tol=rel, abs_tol=1e-9), (got, want)


@pytest.mark.parametrize(
    "grid,last,expected,cell", [("basic", 2030, BASIC_A, (0, 1)), ("calendar_360", 2028, CALENDAR_360_A, (0, 4))]
)
def test_points_match_frozen_answers(spark, request, grid, last, expected, cell):
    params = RainParams(baseline=YearRange(2026, last))
    rows = rain_jobs.index_points_wide(request.getfixturevalue(grid), points(spark), params).collect()
    assert len(rows) == 5 * len(expected)
    for row in rows:
        if row["ponto_id"] == "A":
            assert (row["iy"], row["ix"]) == cell
            same([row[n] for n in NAMES], expected[row["ano"]])


def test_grid_matches_brute_force(basic):
    grid = basic
    params = RainParams(freq_thr_mm=15.0, heavy_thresholds=(10.0, 21.0), baseline=YearRange(2027, 2028))
    got = {(r["iy"], r["ix"], r["ano"]): r for r in rain_jobs.wide_indices(grid, params).collect()}
    pdf = grid.toPandas()
    assert len(got) == 500
    for iy, ix in [(0, 0), (3, 7), (9, 9)]:
        cell = pdf[(pdf.iy == iy) & (pdf.ix == ix)].sort_values("t")
        mm = (cell.valor.to_numpy() * np.float32(86400)).astype(np.float32)
        years = cell.ano.to_numpy()
        base = mm[(years >= 2027) & (years <= 2028)]
        p95 = np.float32(np.quantile(base[base >= 1.0].astype(float), 0.95))
        for year in range(2026, 2031):
            same([got[iy, ix, year][n] for n in NAMES], brute(mm[years == year], params, p95))


def test_missing_days_short_years_and_no_baseline(spark):
    nan = float("nan")
    series = {2001: [nan] * 6, 2002: [30.0, nan, 60.0, 5.0], 2003: [0.0] * 7, 2004: [1, 2, nan, 4, 5, 6.0]}
    rows = [
        (pd.Timestamp(year, 1, 1 + i), year, 0, 0, 1.0, 2.0, float(v))
        for year, values in series.items()
        for i, v in enumerate(values)
    ]
    df = spark.createDataFrame(
        pd.DataFrame(rows, columns=["t", "ano", "iy", "ix", "lat", "lon", "valor"])
    ).withColumn("ano", F.col("ano").cast("int"))
    params = RainParams()
    out = {r["ano"]: [r[n] for n in NAMES] for r in rain_jobs.wide_indices(finish(df, "f", "mm/day"), params).collect()}
    for year, values in series.items():
        same(out[year], brute(values, params, None))
    assert out[2001] == [0, None, None, None, 0, 0, None, None]
    assert out[2002][3] is None and out[2003][1] is None


def test_unit_rule_is_per_file(spark):
    values = np.array([1.0, 4.9], dtype=np.float32).reshape(2, 1, 1)
    args = ([0.0], [0.0], "2001-01-01")
    low = long_grid(spark, values, *args, "low.nc", "mm/day", "pr")
    high = long_grid(spark, values + 0.1, *args, "high.nc", "mm/day", "pr")
    flux = long_grid(spark, values * 100, *args, "flux.nc", "KG M-2 S-1", "pr")
    empty = long_grid(spark, values * np.nan, *args, "empty.nc", "mm/day", "pr")
    union = low.unionByName(high).unionByName(flux).unionByName(empty)
    rows = rain.to_mm_day_by_file(union).collect()
    converted = {r["arquivo"]: r["conversao_unidade_aplicada"] for r in rows}
    assert converted == {"low.nc": True, "high.nc": False, "flux.nc": True, "empty.nc": False}
    assert max(r["valor"] for r in rows if r["arquivo"] == "low.nc") == pytest.approx(4.9 * 86400, rel=1e-6)
    assert {r["units"] for r in rows} == {"mm/day"}


def test_long_form_has_units_and_nulls(basic):
    params = RainParams(baseline=YearRange(2026, 2026))
    bbox = BBox(-23.0, -22.9, -47.0, -46.0)
    out = rain_jobs.index_grid(basic, params, F.lit("exec_1"), bbox)
    rows = out.collect()
    assert len(rows) == 4 * 5 * 8
    assert {r["nome_indice"]: r["unidade"] for r in rows} == {
        "wet_days": "dias", "sdii": "mm/day", "rx1day": "mm", "rx5day": "mm", "r20mm": "dias",
        "r50mm": "dias", "r95ptot_mm": "mm", "r95ptot_frac": "adimensional",
    }
    assert len({r["id"] for r in rows}) == len(rows)


def test_attached_threshold_equals_the_window(basic):
    grid = basic.filter("iy < 2")
    params = RainParams(p95_wet_thr=1e-5, freq_thr_mm=1e-4, heavy_thresholds=(1e-4, 2e-4), baseline=YearRange(2027, 2029))
    joined = rain.annual_indices(rain.attach_p95(grid, rain.p95_by_cell(grid, params)), params)
    windowed = rain.annual_indices(rain.with_p95(grid, params), params)
    assert joined.exceptAll(windowed).isEmpty() and windowed.exceptAll(joined).isEmpty()


def test_same_answer_for_any_partitioning(basic):
    params = RainParams(baseline=YearRange(2026, 2030))
    grid = basic.filter("iy = 0")
    one = rain_jobs.wide_indices(grid.coalesce(1), params)
    many = rain_jobs.wide_indices(grid.orderBy(F.rand(3)).repartition(7), params)
    assert one.exceptAll(many).isEmpty()


def test_one_exchange_and_one_sort(basic):
    params = RainParams(baseline=YearRange(2026, 2030))
    grid = basic
    plan = rain.annual_indices(rain.with_p95(grid, params), params)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_bucketed_table_needs_no_exchange(spark, basic):
    from garoa.sinks import tables

    params = RainParams(baseline=YearRange(2026, 2030))
    tables.write_grid(basic.filter("iy < 2"), "grade_teste", 4)
    grid = spark.table("grade_teste")
    plan = rain.annual_indices(rain.with_p95(grid, params), params)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_snap_ties_and_far_points(spark):
    rng = np.random.default_rng(5)
    cells = [(iy, ix, -30 + iy * 0.25, 300 + ix * 0.5) for iy in range(40) for ix in range(50)]
    asked = [(i, float(a), float(o)) for i, (a, o) in enumerate(
        zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60), strict=True))]
    asked += [(100, -29.875, -59.75), (101, -30.0, 300.25), (102, 80.0, 179.9), (103, -29.875, -59.75)]
    cells_df = spark.createDataFrame(cells, "iy int, ix int, lat double, lon double")
    asked_df = spark.createDataFrame(asked, "ponto_id int, lat double, lon double")
    got = {r["ponto_id"]: (r["iy"], r["ix"]) for r in spatial.snap_to_grid(asked_df, cells_df).collect()}
    assert len(got) == len(asked)
    for i, lat, lon in asked:
        x = (lon + 180) % 360 - 180
        want = min(((la - lat) ** 2 + (((lo + 180) % 360 - 180) - x) ** 2, iy, ix) for iy, ix, la, lo in cells)
        assert got[i] == want[1:], (i, lat, lon)


def test_snap_on_a_rotated_grid(spark):
    rng = np.random.default_rng(6)
    c, s = math.cos(0.4), math.sin(0.4)
    cells = [(iy, ix, 0.2 * (iy * c - ix * s), 0.2 * (iy * s + ix * c) - 10) for iy in range(70) for ix in range(35)]
    asked = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-9, 16, 80), rng.uniform(-14, 9, 80), strict=True))]
    got = spatial.snap_to_grid(
        spark.createDataFrame(asked, "ponto_id int, lat double, lon double"),
        spark.createDataFrame(cells, "iy int, ix int, lat double, lon double"),
    ).collect()
    norm = [(iy, ix, la, (lo + 180) % 360 - 180) for iy, ix, la, lo in cells]
    for r in got:
        x = (r["lon"] + 180) % 360 - 180
        want = min(((la - r["lat"]) ** 2 + (lo - x) ** 2, iy, ix) for iy, ix, la, lo in norm)
        assert (r["iy"], r["ix"]) == want[1:]


@pytest.mark.parametrize("broadcast", [0, 16_000])
def test_snap_through_four_levels(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spatial, "LEAF_CELLS", 2)
    monkeypatch.setattr(spatial, "FAN", 2)
    monkeypatch.setattr(spatial, "BROADCAST_LEAVES", broadcast)
    rng = np.random.default_rng(7)
    cells = [(iy, ix, 0.1 * iy - 2 + 0.02 * math.sin(ix), 358 + 0.1 * ix) for iy in range(50) for ix in range(37) if (iy * ix) % 11]
    asked = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-4, 5, 120), rng.uniform(-4, 4, 120), strict=True))]
    asked += [(200, -2.0, -2.0), (201, None, 1.0), (202, 1.0, None), (203, -2.0, -2.0)]
    asked_df = spark.createDataFrame(asked, "ponto_id int, lat double, lon double")
    cells_df = spark.createDataFrame(cells, "iy int, ix int, lat double, lon double")
    levels, top = spatial._levels(
        cells_df.groupBy(*spatial._tile("iy", "ix", 2)).agg(F.lit(0).alias("cells"), *spatial._extent("lat", "lat", "lon", "lon"))
    )
    assert len(levels) == 4 and top.count() <= 4
    assert all(level.agg(F.max(F.size("children"))).first()[0] <= 4 and level.count() <= size for level, size in levels)
    got = {r["ponto_id"]: (r["iy"], r["ix"]) for r in spatial.snap_to_grid(asked_df, cells_df).collect()}
    assert len(got) == len(asked) and got[201] == got[202] == (None, None)
    for i, lat, lon in asked:
        if None not in (lat, lon):
            want = min(((la - lat) ** 2 + (((lo + 180) % 360 - 180) - lon) ** 2, iy, ix) for iy, ix, la, lo in cells)
            assert got[i] == want[1:], (i, lat, lon)
    assert spatial.snap_to_grid(asked_df, cells_df.limit(0)).filter("iy IS NULL").count() == len(asked)


def test_year_range_is_checked():
    with pytest.raises(ValidationError):
        YearRange(2001, 2000)
