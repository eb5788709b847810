"""Water stress: frozen series, analytic answers, three grids, overlap and calendars."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from grids import long_grid
from pyspark.sql import functions as F

from garoa.errors import GridReadError, NotFoundError
from garoa.functions import numeric as N
from garoa.operators import stress as S
from garoa.params import StressParams
from garoa.plans import stress_jobs
from garoa.sources.grid import as_grid

PR = [0.5, 0.2, 5.0, 0.0, 0.1, 2.0, 0.3, 0.0, 10.0, 0.4]
TAS = [28.0, 32.0, 31.5, 25.0, 33.0, 29.0, 35.0, 27.0, 30.5, 24.0]
EVAP = [3.0, 4.5, 2.0, 1.0, 5.0, 2.5, 6.0, 1.5, 4.0, 0.8]
DAYS = "cenario string, municipio_id bigint, t timestamp_ntz, pr double, tas double, evap double"


def days(spark, rows):
    return spark.createDataFrame(rows, DAYS)


def series(spark, pr, tas, evap, start="2026-01-01"):
    stamps = pd.date_range(start, periods=len(pr))
    return days(spark, [("rcp45", 1, t.to_pydatetime(), float(a), float(b), float(c)) for t, a, b, c in zip(stamps, pr, tas, evap, strict=True)])


def one(df):
    return df.collect()[0]


def test_frozen_series(spark):
    row = one(S.water_stress(series(spark, PR, TAS, EVAP), StressParams()))
    assert row["dias_secos_quentes"] == 3
    assert row["intensidade_mm_dia"] == pytest.approx(4.966666666666667)
    assert row["deficit_total_mm"] == pytest.approx(11.8)


def test_limits_are_inclusive_and_missing_days_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    row = one(S.water_stress(series(spark, [1.0, 1.0, nan, 0.0, 0.0], [30.0, 29.999, 40, inf, 40], [3.0, 3, 3, 3, nan]), StressParams()))
    assert (row["dias_secos_quentes"], row["intensidade_mm_dia"], row["deficit_total_mm"]) == (1, 2.0, 4.0)


def test_years_without_valid_or_hot_days_are_zero(spark):
    nan = float("nan")
    row = one(S.water_stress(series(spark, [nan, nan], [35.0, 35], [1.0, 1]), StressParams()))
    assert (row["dias_secos_quentes"], row["intensidade_mm_dia"], row["deficit_total_mm"]) == (0, 0.0, 0.0)
    row = one(S.water_stress(series(spark, [5.0, 6], [35.0, 35], [1.0, 1]), StressParams()))
    assert (row["dias_secos_quentes"], row["intensidade_mm_dia"], row["deficit_total_mm"]) == (0, 0.0, -9.0)


def three(spark, n=5, days_=730):
    """One cell per municipality: no rain, 35 degrees, 5 mm of evaporation."""
    lon = np.linspace(-48, -32, n)
    parts = [
        long_grid(spark, np.full((days_, 1, n), v), [5.0], lon, "2030-01-01", f"{name}.nc", units, name)
        for name, v, units in (("pr", 0.0, "mm/day"), ("tas", 35.0, "degC"), ("evspsbl", 5.0, "mm/day"))
    ]
    grid = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = [(v, 0, i, 1000000 + i) for v in S.VARIABLES for i in range(n)]
    return grid, spark.createDataFrame(rows, "variavel string, iy int, ix int, municipio_id bigint")


def test_analytic_pipeline(spark):
    grid, cells = three(spark)
    rows = stress_jobs.water_stress_run(grid, cells, StressParams(), F.lit("exec_1")).collect()
    assert len(rows) == 10
    assert {(r["frequencia_dias_secos_quentes"], r["intensidade_mm_dia"]) for r in rows} == {(365, 5.0)}
    assert {r["ano"] for r in rows} == {2030, 2031} and len({r["id"] for r in rows}) == 10


def test_only_municipalities_of_all_three_grids(spark):
    grid, cells = three(spark, days_=20)
    partial = cells.filter("NOT (variavel = 'evspsbl' AND ix = 0)").filter("NOT (variavel = 'tas' AND ix IN (1, 2))")
    rows = stress_jobs.water_stress_run(grid, partial, StressParams(), F.lit("e")).collect()
    assert {r["municipio_id"] for r in rows} == {1000003, 1000004}
    report = {r["categoria"]: (r["total"], r["amostra"]) for r in S.divergence_report(partial).collect()}
    assert report == {"em_pr_tas_mas_nao_evap": (1, [1000000]), "em_pr_evap_mas_nao_tas": (2, [1000001, 1000002])}
    assert tuple(one(S.divergence_totals(partial))) == (3, 2)


def test_mean_skips_missing_cells(spark):
    nan = float("nan")
    values = np.array([[[2.0, 4.0, nan]], [[nan, nan, nan]]])
    grid = long_grid(spark, values, [1.0], [1.0, 2.0, 3.0], "2030-01-01", "f.nc", "mm/day", "pr")
    cells = spark.createDataFrame([(0, 0, 7), (0, 1, 7), (0, 2, 7)], "iy int, ix int, municipio_id bigint")
    rows = {r["t"].day: r["valor"] for r in S.municipality_mean(grid, cells).collect()}
    assert rows == {1: 3.0, 2: None}
    assert S.series_of_municipality(grid, cells, 7).count() == 2
    with pytest.raises(NotFoundError):
        S.series_of_municipality(grid, cells, 8)


def test_overlapping_files_keep_the_first(spark):
    def part(name, value, start):
        return long_grid(spark, np.full((3, 1, 2), value), [1.0], [1.0, 2.0], start, name, "mm/day", "pr")

    union = part("b.nc", 2.0, "2030-01-02").unionByName(part("a.nc", 1.0, "2030-01-01"))
    rows = S.keep_first_file(union).select("t", "valor").distinct().collect()
    assert {(r["t"].day, r["valor"]) for r in rows} == {(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0)}
    kept = S.keep_first_file(union)
    assert kept.count() == 8 and "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_files_that_split_a_time_step_lose_nothing(spark):
    whole = long_grid(spark, np.arange(60.0).reshape(10, 2, 3), range(2), range(3), "2030-01-01", "a", "mm/day", "pr")
    parts = whole.withColumn("arquivo", F.concat(F.lit("part-"), (F.col("ix") % 2).cast("string")))
    assert S.keep_first_file(parts).count() == 60
    assert S.keep_first_file(whole) is whole


def test_units_and_calendar(spark):
    rows = [("pr", 2.0 / 86400, "kg m-2 s-1"), ("pr", 3.0, "mm/day"), ("evspsbl", 0.5, ""), ("tas", 300.0, "K"), ("tas", 25.0, " DegC"), ("tas", 300.0, "")]
    out = S.canonical_units(spark.createDataFrame(rows, "variavel string, valor double, units string")).collect()
    assert [round(r["valor"], 6) for r in out] == [2.0, 3.0, 0.5, 26.85, 25.0, 26.85]
    parts = spark.createDataFrame([(2026, 2, 28), (2026, 2, 30), (2027, 2, 29), (2028, 2, 29)], "cal_year int, cal_month int, cal_day int")
    assert [r["t"].strftime("%F") for r in S.normalize_calendar(parts).collect()] == ["2026-02-28", "2028-02-29"]


def test_different_hours_do_not_meet_and_fail_only_their_scenario(spark):
    grid, cells = three(spark, n=2, days_=10)
    noon = F.when(F.col("variavel") == "evspsbl", F.col("t") + F.expr("INTERVAL 12 HOURS")).otherwise(F.col("t"))
    both = grid.unionByName(grid.withColumns({"cenario": F.lit("rcp85"), "t": noon})).withColumn("cenario_arquivo", F.lit("unknown"))
    out, checks = stress_jobs.water_stress_batch(both, cells, StressParams())
    assert {r["cenario"] for r in out.collect()} == {"rcp45"}
    assert {r["cenario"]: (r["ok"], r["motivo"]) for r in checks.collect()} == {
        "rcp45": (True, None), "rcp85": (False, "intersecao_temporal_vazia"),
    }


def test_one_pass_equals_three_means_and_joins(spark):
    rng = np.random.default_rng(1)
    parts, maps = [], []
    for i, (name, shape) in enumerate((("pr", (40, 4, 5)), ("tas", (35, 4, 5)), ("evspsbl", (38, 3, 3)))):
        values = rng.uniform(0, 40, shape)
        values[rng.uniform(size=shape) < 0.2] = np.nan
        parts.append(long_grid(spark, values, range(shape[1]), range(shape[2]), f"2030-01-0{i + 1}", f"{name}.nc", "degC" if name == "tas" else "mm/day", name))
        maps += [(name, y, x, (y * 7 + x * 3) % (4 + i)) for y in range(shape[1]) for x in range(shape[2])]
    grid = parts[0].unionByName(parts[1]).unionByName(parts[2])
    cells = spark.createDataFrame(maps, "variavel string, iy int, ix int, municipio_id bigint")
    daily = S.municipality_mean(grid, cells, ("variavel", "iy", "ix"))
    joined = S.align_three(*[daily.filter(F.col("variavel") == v) for v in S.VARIABLES])
    one_pass = S.municipality_days(grid, cells)

    def values(df):
        return sorted((r["municipio_id"], r["t"], *[None if r[c] is None else round(r[c], 6) for c in ("pr", "tas", "evap")]) for r in df.collect())

    assert values(joined) == values(one_pass) and len(values(joined)) > 100


def test_numeric_helpers(spark):
    row = one(spark.range(1).select(
        N.normalize_lon(F.lit(180.0)).alias("a"), N.normalize_lon(F.lit(-180.0)).alias("b"), N.normalize_lon(F.lit(359.5)).alias("c"),
        N.normalize_lon(F.lit(-541.0)).alias("d"), N.haversine_km(F.lit(-23.55), F.lit(-46.63), F.lit(-22.9), F.lit(-43.2)).alias("km"),
        N.iso_to_ts(F.lit("2026-01-01T03:00:00-03:00")).cast("string").alias("t"), N.iso_to_ts(F.lit("2026-01-01T03:00:00")).cast("string").alias("u"),
    ))
    assert (row["a"], row["b"], row["c"], row["d"]) == (-180.0, -180.0, -0.5, 179.0)
    assert row["km"] == pytest.approx(358.4, abs=1.5)
    assert (row["t"], row["u"]) == ("2026-01-01 06:00:00", "2026-01-01 03:00:00")


def grid_of(spark, stamps, variables=S.VARIABLES):
    """A one-cell grid; ``stamps`` has the calendar parts of each day, by variable where they differ."""
    rows = [(v, *p, 0.0, 35.0 if v == "tas" else 0.5) for v in variables for p in (stamps[v] if isinstance(stamps, dict) else stamps)]
    df = spark.createDataFrame(rows, "variavel string, cal_year int, cal_month int, cal_day int, cal_hour int, lat double, valor double")
    df = df.withColumns({"lon": F.col("lat"), "iy": F.lit(0), "ix": F.lit(0), "units": F.when(F.col("variavel") == "tas", "degC").otherwise("mm/day")})
    grids = [as_grid(df, v, cenario=F.lit("rcp45")) for v in variables]
    return grids[0].unionByName(grids[1]).unionByName(grids[2])


def map_of(spark):
    return spark.createDataFrame([(v, 0, 0, 7) for v in S.VARIABLES], "variavel string, iy int, ix int, municipio_id bigint")


def test_days_that_do_not_exist_leave_no_row(spark):
    grid = grid_of(spark, [(2001, 2, d, 0) for d in (28, 29, 30)])
    rows = stress_jobs.water_stress_run(grid, map_of(spark), StressParams(), F.lit("e")).collect()
    assert [(r.id, r.ano, r.frequencia_dias_secos_quentes) for r in rows] == [("e_7_2001", 2001, 1)]


def test_the_hour_is_kept_and_no_common_time_is_an_error(spark):
    stamps = {v: [(2001, 1, 1, 12 if v == "evspsbl" else 0)] for v in S.VARIABLES}
    with pytest.raises(GridReadError, match="no time step"):
        stress_jobs.water_stress_run(grid_of(spark, stamps), map_of(spark), StressParams(), F.lit("e"))


def _timed(spark, rows):
    """A grid of one cell from ``(cenario, variavel, arquivo, t[, cenario_arquivo])``."""
    full = [(c, v, a, datetime.fromisoformat(t), 0, 0, 1.0, own) for c, v, a, t, own in ((*r, None)[:5] for r in rows)]
    return spark.createDataFrame(full, "cenario string, variavel string, arquivo string, t timestamp_ntz, iy int, ix int, valor double, cenario_arquivo string")


def test_day_bitmaps_tell_overlaps_common_steps_and_spans(spark):
    days = [f"{y}-{m:02d}-{d:02d}T{h}" for y in (1850, 1969, 1970, 2059, 2061) for m, d in ((1, 1), (2, 28), (12, 31)) for h in ("00:00:00", "12:00:00.25")]
    rows = [("a", v, f"{v}1.nc", t) for v in ("pr", "tas", "evspsbl") for t in days]
    rows += [("a", "pr", "pr2.nc", days[3]), ("b", "pr", "p.nc", days[0]), ("b", "tas", "t.nc", days[1]), ("b", "evspsbl", "e.nc", days[0])]
    rows += [("c", v, f"{v}.nc", t, "z" if v == "tas" else None) for v in ("pr", "tas", "evspsbl") for t in days[:4]]
    grid = _timed(spark, rows).repartition(4)
    index = S.step_index(grid)
    common = {r.cenario: (r.dias_comuns, r.outro) for r in S.common_steps(index).collect()}
    assert common == {"a": (len(days), False), "b": (0, False), "c": (4, True)}
    assert [tuple(r) for r in S.contested_series(index).collect()] == [("a", "pr")]
    spans = {r.variavel: (str(r.inicio), str(r.fim), r.n) for r in S.time_span(grid).collect()}
    assert spans["pr"] == ("1850-01-01 00:00:00", "2061-12-31 12:00:00.250000", len(days))
    kept = S.keep_first_file(grid.filter("cenario = 'a' and variavel = 'pr'")).collect()
    assert len(kept) == len(days) and {r.arquivo for r in kept} == {"pr1.nc"}


def test_failed_scenarios_go_before_the_shuffle(spark):
    days = [f"2000-01-{d:02d}T00:00:00" for d in range(1, 20)]
    rows = [("good", v, f"{v}.nc", t) for v in ("pr", "tas", "evspsbl") for t in days]
    rows += [("bad", v, f"{v}.nc", t, "other") for v in ("pr", "tas", "evspsbl") for t in days]
    grid = _timed(spark, rows).withColumns({"units": F.lit("mm/day"), "ano": F.lit(2000)})
    cells = spark.createDataFrame([(v, 0, 0, 7) for v in ("pr", "tas", "evspsbl")], "variavel string, iy int, ix int, municipio_id long")
    out, checks = stress_jobs.water_stress_batch(grid, cells, StressParams())
    assert {(r.cenario, r.motivo) for r in checks.collect()} == {("good", None), ("bad", "cenario_inconsistente")}
    assert [r.cenario for r in out.collect()] == ["good"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "LeftSemi" not in plan


def test_crowded_files_and_few_overlaps_keep_the_same_rows(spark, monkeypatch):
    """Part files that hold some cells of every day: one exchange by cell serves the rule and the join with the map."""
    n = 6 * 40 * 3
    grid = spark.range(n).select(
        F.lit("a").alias("cenario"), F.when(F.col("id") % 3 == 0, "pr").when(F.col("id") % 3 == 1, "tas").otherwise("evspsbl").alias("variavel"),
        F.concat(F.lit("f"), F.floor(F.col("id") / 120) * 3 % 5, F.lit(".nc")).alias("arquivo"),
        (F.lit(datetime(1969, 12, 1, 12, 0, 0, 250000)) + F.make_dt_interval((F.col("id") / 3 % 40).cast("int"))).cast("timestamp_ntz").alias("t"),
        F.lit(0).alias("iy"), F.floor(F.col("id") / 120).cast("int").alias("ix"), F.col("id").cast("double").alias("valor"),
    )
    copies = grid.filter("ix < 2").withColumns({"arquivo": F.lit("a.nc"), "valor": F.lit(-1.0)})
    own = grid.filter("ix = 5").withColumns({"arquivo": F.lit("z.nc"), "t": F.col("t") + F.expr("INTERVAL 90 DAYS")})
    unnamed = copies.limit(9).withColumns({"arquivo": F.lit(None).cast("string"), "valor": F.lit(-2.0)})
    grid = grid.unionByName(copies).unionByName(own).unionByName(own).unionByName(unnamed).persist()
    index = S.step_index(grid)
    rows = [tuple(r) for r in grid.collect()]
    files = {}
    for r in rows:
        files.setdefault((r[1], r[3]), set()).add(r[2])
    crowd = {k for k, v in files.items() if len(v - {None}) > 1}
    assert {(r.variavel, r.t) for r in S.contested_steps(index).collect()} == crowd and 0 < len(crowd) < len(files)
    want = [r for r in rows if (r[1], r[3]) not in crowd]
    first = {}
    for r in rows:
        if (r[1], r[3]) in crowd:
            k = (r[1], r[3], r[4], r[5])
            first[k] = min(first.get(k, r), r, key=lambda x: x[2] or "")
    want = sorted(map(repr, want + list(first.values())))
    assert S.files_per_step(index) > 2
    for crowded in (2, 1000):
        monkeypatch.setattr(S, "CROWDED", crowded)
        assert sorted(repr(tuple(r)) for r in S.keep_first_file(grid, index).collect()) == want
    monkeypatch.setattr(S, "CROWDED", 2)
    monkeypatch.setattr(S, "broadcast_if_small", lambda df, *_: df)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        cells = spark.range(6).select(F.explode(F.array(*[F.lit(v) for v in S.VARIABLES])).alias("variavel"), F.floor(F.col("id") / 120).cast("int").alias("iy"), F.col("id").cast("int").alias("ix"), F.col("id").alias("municipio_id"))
        plan = S.place_in_municipality(S.keep_first_file(grid, index), cells, ("variavel", "iy", "ix"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(iy#") == 2 and plan.count("Exchange hashpartitioning(variavel#") == 0, plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    grid.unpersist()


def test_step_index_sorts_nothing(spark):
    """Bits are set in numbers by hash aggregates; contested steps come from the index, without another pass over the grid."""
    days = [f"2000-01-{d:02d}T00:00:00" for d in range(1, 20)]
    grid = _timed(spark, [("a", v, f"{v}.nc", t) for v in S.VARIABLES for t in days])
    index = S.step_index(grid)
    assert dict(index.dtypes)["dias"] == "bigint"
    for df in (S.common_steps(index), S.contested_series(index), S.contested_steps(index)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
