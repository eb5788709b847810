"""Queries on water stress and municipality series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.rain_queries import day
from checks.registry import query, scratch
from garoa.functions import numeric as N
from garoa.operators import results as R
from garoa.operators import stress as S
from garoa.params import Page, StressFilter, StressParams
from garoa.plans import result_queries, stress_jobs
from garoa.sources import grid as G

PARAMS = StressParams(limiar_pr_mm_dia=10.0, limiar_tas_c=30.0)
_DAY = "strftime(t, '%Y-%m-%d') AS dia"
_ROUNDED = "round(intensidade_mm_dia, 6) AS intensidade_mm_dia, round(deficit_total_mm, 6) AS deficit_total_mm"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def raw_units(spark, sf):
    """The three variables in file units: flux, Kelvin, and one in Celsius text."""
    value, name = F.col("valor"), F.col("variavel")
    return B.grid_three(spark, sf).withColumns(
        {
            "valor": F.when(name == "pr", value / 86400.0)
            .when((name == "tas") & (F.col("ano") > 1997), value + 273.15)
            .otherwise(value),
            "units": F.when(name == "pr", F.lit("KG M-2 S-1"))
            .when((name == "tas") & (F.col("ano") > 1997), F.lit(""))
            .when(name == "tas", F.lit(" degC "))
            .otherwise(F.lit("mm/day")),
        }
    )


@query(
    f"""SELECT variavel, iy, ix, {_DAY}, round(CASE WHEN variavel = 'pr' THEN valor / 86400.0 * 86400.0
      WHEN variavel = 'tas' AND ano > 1997 THEN valor + 273.15 - 273.15 ELSE valor END, 6) AS valor,
    CASE WHEN variavel = 'tas' THEN 'degC' ELSE 'mm/day' END AS units FROM grid_three""",
    "grid_three",
)
def canonical_units(spark, sf):
    grid = S.canonical_units(raw_units(spark, sf))
    return grid.select("variavel", "iy", "ix", day(), F.round("valor", 6).alias("valor"), "units")


@query(
    """SELECT CAST(cy AS INTEGER) AS ano, CAST(cm AS INTEGER) AS mes, count(*) AS linhas, count(DISTINCT d) AS dias FROM (
      SELECT year(l_shipdate) AS cy, month(l_shipdate) AS cm,
        try_cast(printf('%04d-%02d-%02d', year(l_shipdate), month(l_shipdate), l_orderkey % 30 + 1) AS DATE) AS d
      FROM lineitem) WHERE d IS NOT NULL GROUP BY 1, 2""",
)
def calendar_360_to_gregorian(spark, sf):
    item = B.table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("cal_year"), F.month("l_shipdate").alias("cal_month"),
        (F.col("l_orderkey") % 30 + 1).cast("int").alias("cal_day"),
    )
    return S.normalize_calendar(item).groupBy(F.year("t").alias("ano"), F.month("t").alias("mes")).agg(
        F.count(F.lit(1)).alias("linhas"), F.countDistinct("t").alias("dias")
    )


@query(
    f"""SELECT arquivo, iy, ix, {_DAY}, valor FROM grid_pr_runs
    QUALIFY row_number() OVER (PARTITION BY iy, ix, t ORDER BY arquivo) = 1""",
    "grid_pr_runs",
)
def keep_first_file(spark, sf):
    return S.keep_first_file(B.grid_pr_runs(spark, sf)).select("arquivo", "iy", "ix", day(), "valor")


@query(
    f"SELECT cenario, variavel, municipio_id, {_DAY}, round(valor, 6) AS valor FROM mun_daily", "mun_daily"
)
def municipality_mean(spark, sf):
    out = S.municipality_mean(B.grid_three(spark, sf), B.cell_map(spark, sf), ("variavel", "iy", "ix"))
    return out.select("cenario", "variavel", "municipio_id", day(), F.round("valor", 6).alias("valor"))


@query(
    f"""SELECT 'pr' AS variavel, m.municipio_id, strftime(g.t, '%Y-%m-%d') AS dia, round(avg(g.valor), 6) AS valor
    FROM grid_pr_gaps g JOIN cells m USING (iy, ix) GROUP BY 2, g.t""",
    "grid_pr_gaps",
    "cells",
)
def municipality_mean_with_gaps(spark, sf):
    out = S.municipality_mean(B.grid_pr_gaps(spark, sf), B.cells(spark, sf))
    return out.select("variavel", "municipio_id", day(), F.round("valor", 6).alias("valor"))


@query(
    f"""SELECT {_DAY}, round(valor, 6) AS valor FROM mun_daily WHERE variavel = 'pr' AND municipio_id =
    (SELECT min(municipio_id) FROM cells)""",
    "mun_daily",
    "cells",
)
def series_of_municipality(spark, sf):
    cells = B.cells(spark, sf)
    first = cells.agg(F.min("municipio_id")).head()[0]
    out = S.series_of_municipality(B.grid_pr(spark, sf), cells, first)
    return out.select(day(), F.round("valor", 6).alias("valor"))


@query(
    f"""SELECT variavel, municipio_id, {_DAY}, round(valor, 6) AS valor FROM mun_daily
    WHERE municipio_id IN (SELECT id FROM municipalities WHERE uf = 'AS')""",
    "mun_daily",
    "municipalities",
)
def series_of_target_municipalities(spark, sf):
    ids = B.municipalities(spark, sf).filter("uf = 'AS'").select(F.col("id").alias("municipio_id"))
    daily = S.municipality_mean(B.grid_three(spark, sf), B.cell_map(spark, sf), ("variavel", "iy", "ix"))
    out = S.filter_municipalities(daily, ids)
    return out.select("variavel", "municipio_id", day(), F.round("valor", 6).alias("valor"))


_DAYS = f"SELECT cenario, municipio_id, {_DAY}, round(pr, 6) AS pr, round(tas, 6) AS tas, round(evap, 6) AS evap FROM mun_days"


@query(_DAYS, "mun_days")
def align_three(spark, sf):
    daily = S.municipality_mean(B.grid_three(spark, sf), B.cell_map(spark, sf), ("variavel", "iy", "ix"))
    parts = [daily.filter(F.col("variavel") == v) for v in S.VARIABLES]
    out = S.align_three(*parts)
    return rounded(out.select("cenario", "municipio_id", day(), "pr", "tas", "evap"), "pr", "tas", "evap")


@query(_DAYS, "mun_days")
def municipality_days(spark, sf):
    out = stress_jobs.water_stress_days(B.grid_three(spark, sf), B.cell_map(spark, sf))
    return rounded(out.select("cenario", "municipio_id", day(), "pr", "tas", "evap"), "pr", "tas", "evap")


@query(
    f"""SELECT municipio_id, {_DAY}, pr <= 10 AND tas >= 30 AS seco_quente, round(evap - pr, 6) AS deficit, true AS valido FROM mun_days""",
    "mun_days",
)
def dry_hot_days(spark, sf):
    days = stress_jobs.water_stress_days(B.grid_three(spark, sf), B.cell_map(spark, sf))
    pr, tas, evap = F.col("pr"), F.col("tas"), F.col("evap")
    return days.select(
        "municipio_id", day(), N.is_dry_hot(pr, tas, 10.0, 30.0).alias("seco_quente"),
        F.round(N.daily_deficit(evap, pr), 6).alias("deficit"), N.valid_day(pr, tas, evap).alias("valido"),
    )


@query(f"SELECT cenario, municipio_id, ano, dias_secos_quentes, {_ROUNDED} FROM stress", "stress")
def water_stress(spark, sf):
    days = stress_jobs.water_stress_days(B.grid_three(spark, sf), B.cell_map(spark, sf))
    return rounded(S.water_stress(days, PARAMS), "intensidade_mm_dia", "deficit_total_mm")


_GAPS = """SELECT cenario, municipio_id, t, CASE WHEN pr = 25 OR (municipio_id + year(t)) % 5 = 0 THEN NULL ELSE pr END AS pr,
    CASE WHEN pr = 25 OR (municipio_id + year(t)) % 5 = 0 THEN NULL ELSE tas END AS tas,
    CASE WHEN pr = 25 OR (municipio_id + year(t)) % 5 = 0 THEN NULL ELSE evap END AS evap FROM mun_days"""


@query(
    f"SELECT cenario, municipio_id, ano, dias_secos_quentes, {_ROUNDED} FROM ({B.stress_sql('(' + _GAPS + ')')})",
    "mun_days",
)
def water_stress_with_gaps(spark, sf):
    gone = (F.col("pr") == 25) | ((F.col("municipio_id") + F.year("t")) % 5 == 0)
    days = stress_jobs.water_stress_days(B.grid_three(spark, sf), B.cell_map(spark, sf))
    days = days.withColumn("tas", F.when(gone, F.lit(float("nan"))).otherwise(F.col("tas")))
    return rounded(S.water_stress(days, PARAMS), "intensidade_mm_dia", "deficit_total_mm")


_STORED = """SELECT 'exec_1_' || municipio_id || '_' || ano AS id, 'exec_1' AS execucao_id, municipio_id, ano, cenario,
    dias_secos_quentes AS frequencia_dias_secos_quentes, round(intensidade_mm_dia, 6) AS intensidade_mm_dia FROM stress"""


def stored(spark, sf):
    """Stored water-stress rows of one run."""
    out = stress_jobs.water_stress_run(
        B.grid_three(spark, sf), B.cell_map(spark, sf), PARAMS, F.lit("exec_1")
    )
    return rounded(out, "intensidade_mm_dia")


@query(_STORED, "stress")
def water_stress_job(spark, sf):
    return stored(spark, sf).drop("criado_em")


_CAL_DAY = "CAST(dayofyear(t) * 7 % 30 + 1 AS INTEGER)"
_360 = f"""SELECT cenario, m.municipio_id, d AS t, avg(valor) FILTER (WHERE variavel = 'pr') AS pr,
    avg(valor) FILTER (WHERE variavel = 'tas') AS tas, avg(valor) FILTER (WHERE variavel = 'evspsbl') AS evap
    FROM (SELECT *, try_cast(printf('%04d-%02d-%02d', year(t), month(t), {_CAL_DAY}) AS DATE) AS d FROM grid_three) g
    JOIN cell_map m USING (variavel, iy, ix) WHERE d IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT variavel) = 3"""


@query(
    f"SELECT cenario, municipio_id, ano, dias_secos_quentes, {_ROUNDED} FROM ({B.stress_sql('(' + _360 + ')')})",
    "grid_three",
    "cell_map",
)
def water_stress_360_day(spark, sf):
    """A calendar of 30-day months, read from wide tables: days that do not exist go."""
    whole = B.grid_three(spark, sf)
    parts = {
        "cal_year": F.year("t"), "cal_month": F.month("t"),
        "cal_day": (F.dayofyear("t") * 7 % 30 + 1).cast("int"), "cal_hour": F.lit(0),
    }
    raw = whole.withColumns(parts).drop("t", "ano")
    grids = [G.as_grid(raw, v, calendario=F.lit("360_day")) for v in S.VARIABLES]
    grid = grids[0].unionByName(grids[1]).unionByName(grids[2])
    days = stress_jobs.water_stress_days(grid, B.cell_map(spark, sf))
    return rounded(S.water_stress(days, PARAMS), "intensidade_mm_dia", "deficit_total_mm")


@query(_STORED.replace("exec_1", "estresse_rcp45"), "stress")
def water_stress_from_folders(spark, sf):
    """Folders to a stored run, twice; a scenario without files fails alone."""
    base = scratch(spark, "folders")
    three = {v: f"{base}/{v}" for v in S.VARIABLES}
    for name, grid in zip(S.VARIABLES, (B.grid_pr(spark, sf), B.grid_tas(spark, sf), B.grid_evap(spark, sf)), strict=True):
        grid.drop("cenario", "arquivo", "ano").write.parquet(three[name])
    folders = {"rcp45": three, "ssp585": {v: f"{base}/none" for v in S.VARIABLES}}
    for _ in range(2):
        done, _ = stress_jobs.water_stress_from_folders(
            spark, folders, B.cell_map(spark, sf), PARAMS, f"{base}/stored"
        )
    if [(r.cenario, r.ok) for r in done.orderBy("cenario").collect()] != [("rcp45", True), ("ssp585", False)]:
        raise ValueError("a folder without files must fail its own scenario only")
    stored_rows = spark.read.parquet(f"{base}/stored").select(
        "id", "execucao_id", F.col("municipio_id").cast("long").alias("municipio_id"), "ano", "cenario",
        "frequencia_dias_secos_quentes", "intensidade_mm_dia",
    )
    return rounded(stored_rows, "intensidade_mm_dia")


def two_scenarios(spark, sf):
    """A second scenario whose evaporation is stamped at noon."""
    grid = B.grid_three(spark, sf).withColumn("cenario_arquivo", F.lit("unknown"))
    noon = F.when(F.col("variavel") == "evspsbl", F.col("t") + F.expr("INTERVAL 12 HOURS")).otherwise(F.col("t"))
    other = grid.withColumns({"cenario": F.lit("rcp85"), "t": noon})
    third = grid.withColumns({"cenario": F.lit("ssp585"), "cenario_arquivo": F.lit("ssp126")})
    return grid.unionByName(other).unionByName(third)


@query(f"SELECT cenario, municipio_id, ano, dias_secos_quentes, {_ROUNDED} FROM stress", "stress")
def water_stress_batch(spark, sf):
    out, _ = stress_jobs.water_stress_batch(two_scenarios(spark, sf), B.cell_map(spark, sf), PARAMS)
    return rounded(out, "intensidade_mm_dia", "deficit_total_mm")


@query(
    """SELECT c.cenario, CASE WHEN c.cenario = 'rcp85' THEN 0 ELSE d.n END AS dias_comuns, c.motivo, c.motivo IS NULL AS ok
    FROM (VALUES ('rcp45', NULL), ('rcp85', 'intersecao_temporal_vazia'), ('ssp585', 'cenario_inconsistente')) c(cenario, motivo),
    (SELECT count(*) AS n FROM (SELECT t FROM grid_pr INTERSECT SELECT t FROM grid_tas INTERSECT SELECT t FROM grid_evap)) d""",
    "grid_pr",
    "grid_tas",
    "grid_evap",
)
def scenario_checks(spark, sf):
    return stress_jobs.scenario_checks(two_scenarios(spark, sf))


@query(
    """SELECT strftime(t, '%Y-%m-%d') AS dia FROM (SELECT t FROM grid_pr INTERSECT SELECT t FROM grid_tas INTERSECT SELECT t FROM grid_evap)""",
    "grid_pr",
    "grid_tas",
    "grid_evap",
)
def common_times(spark, sf):
    return S.common_times(B.grid_pr(spark, sf), B.grid_tas(spark, sf), B.grid_evap(spark, sf)).select(day())


@query("SELECT municipio_id FROM cells INTERSECT SELECT municipio_id FROM evap_cells", "cells", "evap_cells")
def common_municipalities(spark, sf):
    return S.common_municipalities(B.cells(spark, sf), B.evap_cells(spark, sf))


def mapped(spark, sf):
    """Three maps of different reach: by supplier, by large supplier balance, by customer of a segment."""
    rich = F.col("s_acctbal") > 5000
    own = B.table(spark, sf, "supplier")
    pr = own.select(F.lit("pr").alias("variavel"), F.col("s_nationkey").cast("bigint").alias("municipio_id"))
    tas = own.filter(rich).select(F.lit("tas").alias("variavel"), F.col("s_nationkey").cast("bigint").alias("municipio_id"))
    evap = (
        B.table(spark, sf, "customer").filter(F.col("c_acctbal") > 9800)
        .select(F.lit("evspsbl").alias("variavel"), F.col("c_nationkey").cast("bigint").alias("municipio_id"))
    )
    return pr.unionByName(tas).unionByName(evap)


_FLAGS = """(SELECT municipio_id, bool_or(v = 'pr') AS pr, bool_or(v = 'tas') AS tas, bool_or(v = 'evspsbl') AS evspsbl FROM (
    SELECT 'pr' AS v, CAST(s_nationkey AS BIGINT) AS municipio_id FROM supplier
    UNION ALL SELECT 'tas', CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal > 5000
    UNION ALL SELECT 'evspsbl', CAST(c_nationkey AS BIGINT) FROM customer WHERE c_acctbal > 9800) GROUP BY 1)"""


@query(
    f"""SELECT categoria, count(*) AS total, array_to_string(list_sort(list(municipio_id))[1:10], ',') AS amostra FROM (
      SELECT municipio_id, CASE WHEN pr AND tas AND NOT evspsbl THEN 'em_pr_tas_mas_nao_evap' WHEN pr AND NOT tas AND evspsbl THEN 'em_pr_evap_mas_nao_tas'
      WHEN NOT pr AND tas AND evspsbl THEN 'em_tas_evap_mas_nao_pr' WHEN pr AND NOT tas THEN 'so_em_pr' WHEN tas AND NOT pr THEN 'so_em_tas'
      WHEN evspsbl AND NOT pr THEN 'so_em_evap' END AS categoria FROM {_FLAGS}) WHERE categoria IS NOT NULL GROUP BY 1""",
)
def divergence_report(spark, sf):
    out = S.divergence_report(mapped(spark, sf))
    return out.withColumn("amostra", F.array_join(F.col("amostra").cast("array<string>"), ","))


@query(
    f"""SELECT count(*) FILTER (WHERE NOT (pr AND tas AND evspsbl)) AS total_pulados,
    count(*) FILTER (WHERE pr AND tas AND evspsbl) AS total_processados FROM {_FLAGS}""",
)
def divergence_totals(spark, sf):
    return S.divergence_totals(mapped(spark, sf))


@query(
    """SELECT variavel, strftime(min(t), '%Y-%m-%d') AS inicio, strftime(max(t), '%Y-%m-%d') AS fim, count(DISTINCT t) AS n
    FROM grid_three GROUP BY 1""",
    "grid_three",
)
def time_span(spark, sf):
    out = S.time_span(B.grid_three(spark, sf))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("inicio", "fim")})


# --- stored water-stress results --------------------------------------------

_NAMED = f"""SELECT s.*, m.nome AS nome_municipio, m.uf FROM ({_STORED}) s
    LEFT JOIN (SELECT * FROM municipalities WHERE uf <> 'EU') m ON m.id = s.municipio_id"""


def some_municipalities(spark, sf):
    """The dimension without one UF, so that some ids are unknown to it."""
    return B.municipalities(spark, sf).filter("uf <> 'EU'")


@query(_NAMED, "stress", "municipalities")
def stress_with_municipality(spark, sf):
    return R.stress_with_municipality(stored(spark, sf).drop("criado_em"), some_municipalities(spark, sf))


@query(
    f"SELECT * FROM ({_STORED}) WHERE execucao_id = 'exec_1' AND cenario = 'rcp45' AND ano BETWEEN 1996 AND 1999 AND municipio_id IN (SELECT id FROM municipalities WHERE uf = 'AM')",
    "stress",
    "municipalities",
)
def filter_stress(spark, sf):
    f = StressFilter(execucao_id="exec_1", cenario="rcp45", ano_min=1996, ano_max=1999, uf="AM")
    return R.filter_stress(stored(spark, sf).drop("criado_em"), f, B.municipalities(spark, sf))


@query(
    f"SELECT * FROM ({_NAMED}) WHERE ano >= 1997 ORDER BY execucao_id, ano, municipio_id, id LIMIT 50 OFFSET 20",
    "stress",
    "municipalities",
)
def page_stress(spark, sf):
    rows, _ = result_queries.query_stress(
        stored(spark, sf).drop("criado_em"), StressFilter(ano_min=1997), Page(50, 20), some_municipalities(spark, sf)
    )
    return rows


@query(
    "SELECT ano, round(avg(dias_secos_quentes), 6) AS frequencia_media FROM stress GROUP BY 1", "stress"
)
def yearly_mean_frequency(spark, sf):
    return rounded(R.yearly_mean_frequency(stored(spark, sf)), "frequencia_media")


@query(
    "SELECT 'exec_1' AS execucao_id, count(DISTINCT municipio_id) AS municipios_processados, count(*) AS resultados_persistidos FROM stress",
    "stress",
)
def stress_run_summary(spark, sf):
    return stress_jobs.stress_run_summary(stored(spark, sf))
