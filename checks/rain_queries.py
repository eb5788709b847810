"""Queries on grids and rainfall indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import query
from garoa.functions import numeric as N
from garoa.functions import text as X
from garoa.operators import rain, spatial
from garoa.params import BBox, RainParams, YearRange
from garoa.plans import rain_jobs
from garoa.sources import grid as G

PARAMS = RainParams(baseline=YearRange(1995, 1998))
_DAY = "strftime(t, '%Y-%m-%d') AS dia"
_WIDE = "arquivo, iy, ix, ano, lat, lon, wet_days, round(sdii, 6) AS sdii, rx1day, rx5day, r20mm, r50mm, round(r95ptot_mm, 6) AS r95ptot_mm, round(r95ptot_frac, 6) AS r95ptot_frac"


def day(t: str = "t") -> Column:
    return F.date_format(t, "yyyy-MM-dd").alias("dia")


def _wide(df: DataFrame) -> DataFrame:
    rounded = ("sdii", "r95ptot_mm", "r95ptot_frac")
    return df.select(
        *rain.CELL_YEAR, "lat", "lon",
        *[F.round(n, 6).alias(n) if n in rounded else F.col(n) for n in rain.INDEX_NAMES],
    )


@query(
    f"""SELECT cenario, variavel, arquivo, {_DAY}, ano, CAST(dense_rank() OVER (ORDER BY lat) - 1 AS INTEGER) AS iy,
    CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INTEGER) AS ix, lat, lon, valor, units, calendario FROM grid_pr""",
    "grid_pr",
)
def grid_from_wide_table(spark, sf):
    wide = B.grid_pr(spark, sf).select(
        F.col("t").alias("time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.col("valor").alias("pr"), "arquivo", "units", F.lit(0).alias("height"),
    )
    grid = G.as_grid(wide, "pr")
    return grid.withColumn("dia", day()).drop("t")


@query(
    """SELECT a.iy, b.ix, a.lat, b.lon FROM (SELECT DISTINCT iy, lat FROM cells) a, (SELECT DISTINCT ix, lon FROM cells) b""",
    "cells",
)
def mesh_axes(spark, sf):
    cells = B.cells(spark, sf)
    return spatial.mesh_axes(cells.select("iy", "lat").distinct(), cells.select("ix", "lon").distinct())


@query(
    """SELECT variavel, arquivo, count(*) AS linhas, sum(valor) AS total FROM grid_three GROUP BY 1, 2""",
    "grid_three",
)
def union_of_files(spark, sf):
    return B.grid_three(spark, sf).groupBy("variavel", "arquivo").agg(
        F.count(F.lit(1)).alias("linhas"), F.sum("valor").alias("total")
    )


@query(
    """SELECT substr(md5(concat_ws('x', max(iy) + 1, max(ix) + 1, count(*),
      bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)), bit_xor(CAST('0x' || substr(h, 16, 15) AS BIGINT)))), 1, 16) AS grid_id
    FROM (SELECT iy, ix, md5(concat_ws(',', iy, ix, CAST(round(lat * 100000) AS BIGINT), CAST(round(lon * 100000) AS BIGINT))) AS h FROM cells)""",
    "cells",
)
def grid_fingerprint(spark, sf):
    return spatial.grid_fingerprint(B.cells(spark, sf))


@query("SELECT iy, ix, ((lon + 180) % 360) - 180 AS lon FROM cells", "cells")
def normalize_lon(spark, sf):
    return B.cells(spark, sf).select("iy", "ix", N.normalize_lon(F.col("lon")).alias("lon"))


_CONVERTED = """SELECT g.arquivo, g.iy, g.ix, g.t, round(CASE WHEN m.conv THEN g.valor * 86400.0 ELSE g.valor END, 6) AS valor, m.conv
    FROM grid_pr_units g JOIN (SELECT arquivo, bool_or(contains(lower(units), 'kg m-2 s-1')) OR max(valor) < 5 AS conv
    FROM grid_pr_units GROUP BY 1) m USING (arquivo)"""


@query(
    f"SELECT arquivo, iy, ix, {_DAY}, valor, conv AS conversao_unidade_aplicada FROM ({_CONVERTED})",
    "grid_pr_units",
)
def precipitation_to_mm_day(spark, sf):
    return rain.to_mm_day_by_file(B.grid_pr_units(spark, sf)).select(
        "arquivo", "iy", "ix", day(), F.round("valor", 6).alias("valor"), "conversao_unidade_aplicada"
    )


@query("SELECT arquivo, max(valor) AS vmax FROM grid_pr_gaps GROUP BY 1", "grid_pr_gaps")
def dataset_max(spark, sf):
    return rain.dataset_max(B.grid_pr_gaps(spark, sf))


@query(f"SELECT iy, ix, {_DAY}, valor FROM grid_pr_gaps", "grid_pr_gaps")
def nan_to_null(spark, sf):
    return B.grid_pr_gaps(spark, sf).select("iy", "ix", day(), N.nan_to_null(F.col("valor")).alias("valor"))


@query(
    f"""SELECT iy, ix, {_DAY}, valor FROM grid_pr
    WHERE lat BETWEEN -29.5 AND -28.25 AND ((lon + 180) % 360) - 180 BETWEEN -59.5 AND -57""",
    "grid_pr",
)
def grid_bbox(spark, sf):
    grid = rain.filter_grid_bbox(B.grid_pr(spark, sf), BBox(-29.5, -28.25, -59.5, -57.0))
    return grid.select("iy", "ix", day(), "valor")


@query(
    f"""SELECT iy, ix, {_DAY}, valor FROM grid_pr WHERE lat >= -29.75 AND lat <= 90 AND
    (((lon + 180) % 360) - 180 >= -56.5 OR ((lon + 180) % 360) - 180 <= -59)""",
    "grid_pr",
)
def grid_bbox_across_antimeridian(spark, sf):
    grid = rain.filter_grid_bbox(B.grid_pr(spark, sf), BBox(-29.75, 90.0, -56.5, -59.0))
    return grid.select("iy", "ix", day(), "valor")


@query(f"SELECT iy, ix, {_DAY}, valor FROM grid_pr WHERE ano BETWEEN 1996 AND 1998", "grid_pr")
def baseline_years(spark, sf):
    return rain.baseline_years(B.grid_pr(spark, sf), YearRange(1996, 1998)).select("iy", "ix", day(), "valor")


@query(
    """SELECT arquivo, iy, ix, round(quantile_cont(valor, 0.95) FILTER (WHERE valor >= 1 AND ano BETWEEN 1995 AND 1998), 6) AS p95
    FROM grid_pr_gaps GROUP BY 1, 2, 3""",
    "grid_pr_gaps",
)
def p95_by_cell(spark, sf):
    return rain.p95_by_cell(B.grid_pr_gaps(spark, sf), PARAMS).withColumn("p95", F.round("p95", 6))


@query(
    f"""SELECT arquivo, iy, ix, {_DAY}, valor, round(p95, 6) AS p95 FROM grid_pr JOIN
    (SELECT arquivo, iy, ix, quantile_cont(valor, 0.95) FILTER (WHERE valor >= 1 AND ano BETWEEN 1995 AND 1998) AS p95
     FROM grid_pr GROUP BY 1, 2, 3) USING (arquivo, iy, ix)""",
    "grid_pr",
)
def attach_p95(spark, sf):
    grid = B.grid_pr(spark, sf)
    joined = rain.attach_p95(grid, rain.p95_by_cell(grid, PARAMS))
    return joined.select("arquivo", "iy", "ix", day(), "valor", F.round("p95", 6).alias("p95"))


@query(
    f"""SELECT arquivo, iy, ix, {_DAY}, sum(valor) OVER w AS s5, count(*) OVER w AS n5 FROM grid_pr
    WINDOW w AS (PARTITION BY arquivo, iy, ix, ano ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "grid_pr",
)
def moving_sum_5(spark, sf):
    return rain.moving_sum_5(B.grid_pr(spark, sf), F.col("valor")).select("arquivo", "iy", "ix", day(), "s5", "n5")


@query(f"SELECT {_WIDE} FROM ({B.indices_sql('grid_pr')})", "grid_pr")
def annual_indices(spark, sf):
    grid = B.grid_pr(spark, sf)
    return _wide(rain.annual_indices(rain.with_p95(grid, PARAMS), PARAMS))


@query(f"SELECT {_WIDE} FROM ({B.indices_sql('grid_pr_gaps')})", "grid_pr_gaps")
def annual_indices_with_gaps(spark, sf):
    grid = B.grid_pr_gaps(spark, sf)
    return _wide(rain.annual_indices(rain.with_p95(grid, PARAMS), PARAMS))


@query(
    f"""SELECT * REPLACE (NULL::DOUBLE AS r95ptot_mm, NULL::DOUBLE AS r95ptot_frac)
    FROM (SELECT {_WIDE} FROM ({B.indices_sql('grid_pr', 15, 30, 60)}))""",
    "grid_pr",
)
def annual_indices_without_baseline(spark, sf):
    params = RainParams(freq_thr_mm=15.0, heavy_thresholds=(30.0, 60.0))
    return _wide(rain.annual_indices(rain.with_p95(B.grid_pr(spark, sf), params), params))


@query(
    "SELECT arquivo, iy, ix, ano, nome_indice, round(valor, 6) AS valor, unidade FROM long_runs", "long_runs"
)
def indices_long_form(spark, sf):
    grid = B.grid_pr_runs(spark, sf)
    wide = rain.annual_indices(rain.with_p95(grid, PARAMS), PARAMS)
    return rain.to_long(wide, rain.CELL_YEAR).withColumn("valor", F.round("valor", 6))


@query(
    """SELECT id, execucao_id, lat, lon, NULL::DOUBLE AS lat_input, NULL::DOUBLE AS lon_input, ano, nome_indice,
    round(valor, 6) AS valor, unidade, municipio_id FROM results""",
    "results",
)
def index_grid_job(spark, sf):
    out = rain_jobs.index_grid(
        B.grid_pr_runs_gaps(spark, sf), PARAMS, B.run_of_file(), cell_map=B.cells(spark, sf)
    )
    return out.withColumn("valor", F.round("valor", 6))


@query(
    """SELECT execucao_id, count(DISTINCT (lat, lon)) AS total_celulas, count(DISTINCT ano) AS total_anos,
    count(*) AS total_resultados FROM results GROUP BY 1""",
    "results",
)
def run_summary(spark, sf):
    return rain_jobs.run_summary(results(spark, sf))


def results(spark, sf) -> DataFrame:
    """Index results of the three bound runs; cells without a year's days have NULL values."""
    return rain_jobs.index_grid(
        B.grid_pr_runs_gaps(spark, sf), PARAMS, B.run_of_file(), cell_map=B.cells(spark, sf)
    )


_SNAPPED = """SELECT ponto_id, lat, lon, iy, ix, lat_grid, lon_grid FROM (
    SELECT p.ponto_id, p.lat, p.lon, c.iy, c.ix, c.lat AS lat_grid, c.lon AS lon_grid, row_number() OVER (PARTITION BY p.ponto_id
    ORDER BY (c.lat - p.lat) ^ 2 + (((c.lon + 180) % 360) - 180 - (((p.lon + 540) % 360) - 180)) ^ 2, c.iy, c.ix) AS n
    FROM points p, cells c) WHERE n = 1"""


@query(_SNAPPED, "points", "cells")
def snap_to_grid(spark, sf):
    return spatial.snap_to_grid(B.points(spark, sf), B.cells(spark, sf).drop("municipio_id"))


@query(
    f"""SELECT s.ponto_id, s.lat AS lat_input, s.lon AS lon_input, s.lat_grid, s.lon_grid, i.ano, i.wet_days, round(i.sdii, 6) AS sdii,
    i.rx1day, i.rx5day, i.r20mm, i.r50mm, round(i.r95ptot_mm, 6) AS r95ptot_mm, round(i.r95ptot_frac, 6) AS r95ptot_frac
    FROM ({_SNAPPED}) s JOIN ({B.indices_sql('grid_pr')}) i USING (iy, ix)""",
    "points",
    "cells",
    "grid_pr",
)
def index_points_job(spark, sf):
    out = rain_jobs.index_points_wide(B.grid_pr(spark, sf), B.points(spark, sf), PARAMS)
    rounded = ("sdii", "r95ptot_mm", "r95ptot_frac")
    return out.select(
        "ponto_id", "lat_input", "lon_input", "lat_grid", "lon_grid", "ano",
        *[F.round(n, 6).alias(n) if n in rounded else F.col(n) for n in rain.INDEX_NAMES],
    )


_RUN = "'exec_' || CASE WHEN arquivo LIKE '%RCP85%' THEN 'rcp85' ELSE 'rcp26' END"


@query(
    f"""SELECT {_RUN} || '_' || ponto_id || '_' || arquivo || '_' || ano || '_' || nome_indice AS id, {_RUN} AS execucao_id, lat_grid AS lat,
    lon_grid AS lon, s.lat AS lat_input, s.lon AS lon_input, ano, nome_indice, round(valor, 6) AS valor, unidade, NULL::BIGINT AS municipio_id
    FROM ({_SNAPPED}) s JOIN (SELECT * REPLACE (CASE arquivo WHEN 'pr_A.nc' THEN 'pr_A_RCP85_day.nc' ELSE arquivo END AS arquivo) FROM long_runs) i
    USING (iy, ix)""",
    "points",
    "cells",
    "long_runs",
)
def index_points_stored(spark, sf):
    grid = B.grid_pr_runs(spark, sf)
    name = F.when(F.col("arquivo") == "pr_A.nc", "pr_A_RCP85_day.nc").otherwise(F.col("arquivo"))
    run = F.concat(F.lit("exec_"), rain_jobs.scenario_of_run(X.infer_scenario(F.col("arquivo"), []), "rcp26"))
    out = rain_jobs.index_points(grid.withColumn("arquivo", name), B.points(spark, sf), PARAMS, run)
    return out.withColumn("valor", F.round("valor", 6))


@query(
    """SELECT c_custkey, regexp_extract(lower(nome), '(rcp[0-9]{2}|ssp[0-9]{3})', 1) AS achado FROM (
      SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN '_RCP45_day.nc' WHEN 1 THEN '_ssp585.nc' WHEN 2 THEN '_rcp8_ssp12.nc'
      ELSE '_SSP126_rcp85.nc' END AS nome FROM customer) WHERE regexp_extract(lower(nome), '(rcp[0-9]{2}|ssp[0-9]{3})', 1) <> ''""",
)
def detect_scenario(spark, sf):
    k = F.col("c_custkey") % 4
    tail = F.when(k == 0, "_RCP45_day.nc").when(k == 1, "_ssp585.nc").when(k == 2, "_rcp8_ssp12.nc").otherwise("_SSP126_rcp85.nc")
    named = B.table(spark, sf, "customer").select("c_custkey", F.concat("c_name", tail).alias("nome"))
    found = named.select("c_custkey", X.detect_scenario(F.col("nome")).alias("achado"))
    return found.filter(F.col("achado").isNotNull())


@query(
    """SELECT c_custkey, coalesce(no_nome, atributo, 'unknown') AS por_nome, coalesce(atributo, no_nome, 'unknown') AS por_atributo FROM (
      SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'rcp45' END AS no_nome, CASE c_custkey % 2 WHEN 0 THEN lower(c_mktsegment) END AS atributo
      FROM customer)""",
)
def infer_scenario(spark, sf):
    k = F.col("c_custkey")
    rows = B.table(spark, sf, "customer").select(
        k, F.when(k % 3 == 0, "pr_RCP45.nc").otherwise("pr.nc").alias("nome"),
        F.when(k % 2 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise("").alias("attr"),
    )
    attrs = [F.col("attr")]
    return rows.select(
        "c_custkey",
        X.infer_scenario(F.col("nome"), attrs, "name").alias("por_nome"),
        X.infer_scenario(F.col("nome"), attrs, "attrs").alias("por_atributo"),
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000000+00:00' AS iso, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS lido,
    CAST(year(o_orderdate) AS BIGINT) AS ano FROM orders""",
)
def iso_timestamps(spark, sf):
    zoned = F.col("o_orderdate").cast("timestamp")
    rows = B.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", N.ts_to_iso(zoned).alias("iso"))
    back = N.iso_to_ts(F.col("iso"))
    return rows.select(
        "o_orderkey", "iso", F.date_format(back, "yyyy-MM-dd HH:mm:ss").alias("lido"),
        F.year(back).cast("bigint").alias("ano"),
    )
