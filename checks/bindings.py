"""The given tables seen as the library's tables, in Spark and in SQL.

Each Spark function has a common table expression of the same name in
``VIEWS``. Values are built from integers and powers of two, so that both
engines hold the same numbers whatever the order of their sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garoa.functions import text as X
from garoa.operators.sizing import broadcast_if_small, dealt
from garoa.operators.spatial import ring_edges

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    """Register a common table expression and the ones it reads."""
    VIEWS[name] = (needs, sql)


def with_views(sql: str, *needs: str) -> str:
    """Put the needed common table expressions, in order, before a query."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    return f"WITH {parts} {sql}" if parts else sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _div(column: str, by: int) -> Column:
    return F.floor(F.col(column) / by).cast("int")


def _mod(column: str, by: int) -> Column:
    return (F.col(column) % by).cast("int")


# --- cells ------------------------------------------------------------------


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Grid of ``pr`` and ``tas``: one cell per supplier, longitudes in 0-360."""
    return table(spark, sf, "supplier").select(
        _div("s_suppkey", 10).alias("iy"),
        _mod("s_suppkey", 10).alias("ix"),
        (F.lit(-30.0) + _div("s_suppkey", 10) * 0.25).alias("lat"),
        (F.lit(300.0) + _mod("s_suppkey", 10) * 0.5).alias("lon"),
        F.col("s_nationkey").cast("bigint").alias("municipio_id"),
    )


view(
    "cells",
    """SELECT CAST(s_suppkey // 10 AS INTEGER) AS iy, CAST(s_suppkey % 10 AS INTEGER) AS ix,
    CAST(-30 AS DOUBLE) + CAST(s_suppkey // 10 AS DOUBLE) / 4 AS lat,
    CAST(300 AS DOUBLE) + CAST(s_suppkey % 10 AS DOUBLE) / 2 AS lon,
    CAST(s_nationkey AS BIGINT) AS municipio_id FROM supplier""",
)


def evap_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of ``evspsbl``, its own: one cell per customer."""
    return table(spark, sf, "customer").select(
        _div("c_custkey", 50).alias("iy"),
        _mod("c_custkey", 50).alias("ix"),
        (F.lit(-29.0) + _div("c_custkey", 50) * 0.25).alias("lat"),
        (F.lit(-60.0) + _mod("c_custkey", 50) * 0.125).alias("lon"),
        F.col("c_nationkey").cast("bigint").alias("municipio_id"),
    )


view(
    "evap_cells",
    """SELECT CAST(c_custkey // 50 AS INTEGER) AS iy, CAST(c_custkey % 50 AS INTEGER) AS ix,
    CAST(-29 AS DOUBLE) + CAST(c_custkey // 50 AS DOUBLE) / 4 AS lat,
    CAST(-60 AS DOUBLE) + CAST(c_custkey % 50 AS DOUBLE) / 8 AS lon,
    CAST(c_nationkey AS BIGINT) AS municipio_id FROM customer""",
)


def cell_map(spark: SparkSession, sf: str) -> DataFrame:
    """Municipality of every cell of the three grids."""
    near = cells(spark, sf).select("iy", "ix", "municipio_id")
    own = evap_cells(spark, sf).select(F.lit("evspsbl").alias("variavel"), "iy", "ix", "municipio_id")
    both = near.select(F.explode(F.array(F.lit("pr"), F.lit("tas"))).alias("variavel"), "*")
    return both.unionByName(own)


view(
    "cell_map",
    """SELECT 'pr' AS variavel, iy, ix, municipio_id FROM cells
    UNION ALL SELECT 'tas', iy, ix, municipio_id FROM cells
    UNION ALL SELECT 'evspsbl', iy, ix, municipio_id FROM evap_cells""",
    "cells",
    "evap_cells",
)


# --- polygons ---------------------------------------------------------------


def rings(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle per nation; every third one has a rectangular hole."""
    k = F.col("n_nationkey")
    x0, y0 = F.lit(-60.25) + k % 5, F.lit(-30.125) + F.floor(k / 5) * 0.5

    def box(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
        return F.array(F.array(xa, ya), F.array(xb, ya), F.array(xb, yb), F.array(xa, yb), F.array(xa, ya))

    outer = box(x0, y0, x0 + 1.0, y0 + 0.5)
    hole = box(x0 + 0.5, y0 + 0.25, x0 + 0.875, y0 + 0.4375)
    both = F.when(k % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return table(spark, sf, "nation").select(
        k.cast("bigint").alias("municipio_id"),
        F.lit(0).alias("part"),
        F.posexplode(both).alias("ring", "coords"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of those polygons."""
    return ring_edges(rings(spark, sf))


view(
    "boxes",
    """SELECT CAST(n_nationkey AS BIGINT) AS municipio_id,
    CAST(-60.25 AS DOUBLE) + n_nationkey % 5 AS x0, CAST(-30.125 AS DOUBLE) + CAST(n_nationkey // 5 AS DOUBLE) / 2 AS y0,
    n_nationkey % 3 = 0 AS hole FROM nation""",
)


def inside_sql(x: str, y: str) -> str:
    """Inside a box ``b``, outside its hole, borders excluded."""
    return (
        f"{x} > b.x0 AND {x} < b.x0 + 1 AND {y} > b.y0 AND {y} < b.y0 + 0.5 AND NOT (b.hole AND "
        f"{x} >= b.x0 + 0.5 AND {x} <= b.x0 + 0.875 AND {y} >= b.y0 + 0.25 AND {y} <= b.y0 + 0.4375)"
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """A requested point per customer; many share coordinates or lie on a border."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ponto_id"),
        (F.lit(-31.0) + (F.col("c_custkey") % 61) * 0.0625).alias("lat"),
        (F.lit(-61.0) + (F.col("c_custkey") % 113) * 0.0625).alias("lon"),
    )


view(
    "points",
    """SELECT c_custkey AS ponto_id, CAST(-31 AS DOUBLE) + CAST(c_custkey % 61 AS DOUBLE) / 16 AS lat,
    CAST(-61 AS DOUBLE) + CAST(c_custkey % 113 AS DOUBLE) / 16 AS lon FROM customer""",
)


# --- grids ------------------------------------------------------------------


def _grid(daily: DataFrame, where: DataFrame, variavel: str, arquivo: Column, units: str, cenario: str) -> DataFrame:
    return daily.join(broadcast_if_small(where.drop("municipio_id")), ["iy", "ix"]).select(
        F.lit(cenario).alias("cenario"), F.lit(variavel).alias("variavel"), arquivo.alias("arquivo"),
        "t", F.year("t").alias("ano"), "iy", "ix", "lat", "lon", "valor",
        F.lit(units).alias("units"), F.lit("standard").alias("calendario"),
    )


def _by_cell_and_day(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    item = table(spark, sf, "lineitem")
    lines = item.select(
        _div("l_suppkey", 10).alias("iy"), _mod("l_suppkey", 10).alias("ix"), F.col("l_shipdate").alias("t"), *more,
        "l_quantity", F.round(F.col("l_discount") * 100).cast("bigint").alias("cents"),
    )
    return dealt(lines, "iy", "ix").groupBy("iy", "ix", "t", *more).agg(F.sum("l_quantity").alias("qty"), F.sum("cents").alias("cents"))


def grid_pr(spark: SparkSession, sf: str) -> DataFrame:
    """Rain: quantity shipped per supplier and day."""
    daily = _by_cell_and_day(spark, sf).withColumn("valor", F.col("qty"))
    return _grid(daily, cells(spark, sf), "pr", F.lit("pr_rcp45_day.nc"), "mm/day", "rcp45")


view(
    "grid_pr",
    """SELECT 'rcp45' AS cenario, 'pr' AS variavel, 'pr_rcp45_day.nc' AS arquivo, d.t, CAST(year(d.t) AS INTEGER) AS ano,
    d.iy, d.ix, c.lat, c.lon, d.valor, 'mm/day' AS units, 'standard' AS calendario
    FROM (SELECT CAST(l_suppkey // 10 AS INTEGER) AS iy, CAST(l_suppkey % 10 AS INTEGER) AS ix, l_shipdate AS t,
          sum(l_quantity) AS valor FROM lineitem GROUP BY 1, 2, 3) d JOIN cells c USING (iy, ix)""",
    "cells",
)


def grid_pr_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Rain in three files, one per return flag."""
    daily = _by_cell_and_day(spark, sf, "l_returnflag").withColumn("valor", F.col("qty"))
    name = F.concat(F.lit("pr_"), F.col("l_returnflag"), F.lit(".nc"))
    return _grid(daily, cells(spark, sf), "pr", name, "mm/day", "rcp45")


view(
    "grid_pr_runs",
    """SELECT 'rcp45' AS cenario, 'pr' AS variavel, 'pr_' || d.l_returnflag || '.nc' AS arquivo, d.t, CAST(year(d.t) AS INTEGER) AS ano,
    d.iy, d.ix, c.lat, c.lon, d.valor, 'mm/day' AS units, 'standard' AS calendario
    FROM (SELECT CAST(l_suppkey // 10 AS INTEGER) AS iy, CAST(l_suppkey % 10 AS INTEGER) AS ix, l_shipdate AS t,
          l_returnflag, sum(l_quantity) AS valor FROM lineitem GROUP BY 1, 2, 3, 4) d JOIN cells c USING (iy, ix)""",
    "cells",
)


def grid_pr_runs_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The three files without some cells' years."""
    gone = (F.col("iy") * 10 + F.col("ix") + F.col("ano")) % 7 == 0
    return grid_pr_runs(spark, sf).withColumn("valor", F.when(gone, F.lit(float("nan"))).otherwise(F.col("valor")))


def grid_pr_units(spark: SparkSession, sf: str) -> DataFrame:
    """The three files in three units: a flux, unlabelled small values, mm/day."""
    mm, name = F.col("valor"), F.col("arquivo")
    return grid_pr_runs(spark, sf).withColumns(
        {
            "valor": F.when(name == "pr_A.nc", mm / 86400.0).when(name == "pr_N.nc", mm / 1024.0).otherwise(mm),
            "units": F.when(name == "pr_A.nc", F.lit("kg m-2 s-1")).when(name == "pr_N.nc", F.lit("")).otherwise(F.lit("mm/day")),
        }
    )


view(
    "grid_pr_units",
    """SELECT cenario, variavel, arquivo, t, ano, iy, ix, lat, lon,
    CASE arquivo WHEN 'pr_A.nc' THEN valor / 86400 WHEN 'pr_N.nc' THEN valor / 1024 ELSE valor END AS valor,
    CASE arquivo WHEN 'pr_A.nc' THEN 'kg m-2 s-1' WHEN 'pr_N.nc' THEN '' ELSE 'mm/day' END AS units, calendario
    FROM grid_pr_runs""",
    "grid_pr_runs",
)


def grid_pr_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Rain with missing days (value 13) and whole missing years of some cells."""
    gone = (F.col("valor") == 13) | ((F.col("iy") * 10 + F.col("ix") + F.col("ano")) % 7 == 0)
    nan = F.lit(float("nan"))
    return grid_pr(spark, sf).withColumn("valor", F.when(gone, nan).otherwise(F.col("valor")))


view(
    "grid_pr_gaps",
    """SELECT * REPLACE (CASE WHEN valor = 13 OR (iy * 10 + ix + ano) % 7 = 0 THEN NULL ELSE valor END AS valor) FROM grid_pr""",
    "grid_pr",
)


def grid_tas(spark: SparkSession, sf: str) -> DataFrame:
    """Temperature in Celsius, in quarter degrees from 20 to 40, hot on many days."""
    value = F.lit(20.0) + (F.col("cents") * 37 % 81) / 4
    daily = _by_cell_and_day(spark, sf).withColumn("valor", value)
    return _grid(daily, cells(spark, sf), "tas", F.lit("tas_rcp45_day.nc"), "degC", "rcp45")


view(
    "grid_tas",
    """SELECT 'rcp45' AS cenario, 'tas' AS variavel, 'tas_rcp45_day.nc' AS arquivo, d.t, CAST(year(d.t) AS INTEGER) AS ano,
    d.iy, d.ix, c.lat, c.lon, d.valor, 'degC' AS units, 'standard' AS calendario
    FROM (SELECT CAST(l_suppkey // 10 AS INTEGER) AS iy, CAST(l_suppkey % 10 AS INTEGER) AS ix, l_shipdate AS t,
          20 + CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) * 37 % 81 AS DOUBLE) / 4 AS valor
          FROM lineitem GROUP BY 1, 2, 3) d JOIN cells c USING (iy, ix)""",
    "cells",
)


def grid_evap(spark: SparkSession, sf: str) -> DataFrame:
    """Evaporation in eighths of mm/day from 0 to 8, from orders, on its own grid and days."""
    bought = table(spark, sf, "orders").select(
        _div("o_custkey", 50).alias("iy"), _mod("o_custkey", 50).alias("ix"), F.col("o_orderdate").alias("t"), "o_totalprice"
    )
    daily = dealt(bought, "iy", "ix").groupBy("iy", "ix", "t").agg(((F.sum(F.floor("o_totalprice")) % 65) / 8).alias("valor"))
    return _grid(daily, evap_cells(spark, sf), "evspsbl", F.lit("evspsbl_rcp45_day.nc"), "mm/day", "rcp45")


view(
    "grid_evap",
    """SELECT 'rcp45' AS cenario, 'evspsbl' AS variavel, 'evspsbl_rcp45_day.nc' AS arquivo, d.t, CAST(year(d.t) AS INTEGER) AS ano,
    d.iy, d.ix, c.lat, c.lon, d.valor, 'mm/day' AS units, 'standard' AS calendario
    FROM (SELECT CAST(o_custkey // 50 AS INTEGER) AS iy, CAST(o_custkey % 50 AS INTEGER) AS ix, o_orderdate AS t,
          CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) % 65 AS DOUBLE) / 8 AS valor
          FROM orders GROUP BY 1, 2, 3) d JOIN evap_cells c USING (iy, ix)""",
    "evap_cells",
)


def grid_three(spark: SparkSession, sf: str) -> DataFrame:
    """The three variables in one frame."""
    return grid_pr(spark, sf).unionByName(grid_tas(spark, sf)).unionByName(grid_evap(spark, sf))


view(
    "grid_three",
    "SELECT * FROM grid_pr UNION ALL SELECT * FROM grid_tas UNION ALL SELECT * FROM grid_evap",
    "grid_pr",
    "grid_tas",
    "grid_evap",
)

view(
    "mun_daily",
    """SELECT g.cenario, g.variavel, m.municipio_id, g.t, avg(g.valor) AS valor
    FROM grid_three g JOIN cell_map m USING (variavel, iy, ix) GROUP BY 1, 2, 3, 4""",
    "grid_three",
    "cell_map",
)

view(
    "mun_days",
    """SELECT cenario, municipio_id, t, max(valor) FILTER (WHERE variavel = 'pr') AS pr,
    max(valor) FILTER (WHERE variavel = 'tas') AS tas, max(valor) FILTER (WHERE variavel = 'evspsbl') AS evap
    FROM mun_daily GROUP BY 1, 2, 3 HAVING count(DISTINCT variavel) = 3""",
    "mun_daily",
)


def stress_sql(source: str) -> str:
    """Yearly water stress of aligned days."""
    return f"""SELECT cenario, municipio_id, CAST(year(t) AS INTEGER) AS ano,
    CAST(count(*) FILTER (WHERE pr <= 10 AND tas >= 30) AS INTEGER) AS dias_secos_quentes,
    coalesce(avg(evap - pr) FILTER (WHERE pr <= 10 AND tas >= 30), 0) AS intensidade_mm_dia,
    coalesce(sum(evap - pr), 0) AS deficit_total_mm FROM {source} GROUP BY 1, 2, 3"""


view("stress", stress_sql("mun_days"), "mun_days")


# --- indices and stored results ---------------------------------------------


def indices_sql(grid: str, freq: int = 20, low: int = 20, high: int = 50, ini: int = 1995, fim: int = 1998) -> str:
    """The eight indices of a grid in mm/day whose missing values are NULL."""
    return f"""SELECT arquivo, iy, ix, ano, max(lat) AS lat, max(lon) AS lon,
    CAST(count(*) FILTER (WHERE x >= {freq}) AS INTEGER) AS wet_days,
    avg(x) FILTER (WHERE x >= {freq}) AS sdii,
    CASE WHEN bool_or(ok) THEN max(x) END AS rx1day,
    CASE WHEN bool_or(ok) THEN max(s5) FILTER (WHERE n5 = 5) END AS rx5day,
    CAST(count(*) FILTER (WHERE x >= {low}) AS INTEGER) AS r20mm,
    CAST(count(*) FILTER (WHERE x >= {high}) AS INTEGER) AS r50mm,
    CASE WHEN bool_or(ok) AND max(p95) IS NOT NULL THEN coalesce(sum(x) FILTER (WHERE x > p95), 0) END AS r95ptot_mm,
    CASE WHEN sum(x) > 0 AND max(p95) IS NOT NULL THEN coalesce(sum(x) FILTER (WHERE x > p95), 0) / sum(x) END AS r95ptot_frac
    FROM (SELECT g.*, p.p95, valor IS NOT NULL AS ok, coalesce(valor, 0) AS x,
          sum(coalesce(valor, 0)) OVER five AS s5, count(*) OVER five AS n5
          FROM {grid} g JOIN (SELECT arquivo, iy, ix, quantile_cont(valor, 0.95)
               FILTER (WHERE valor >= 1 AND ano BETWEEN {ini} AND {fim}) AS p95
               FROM {grid} GROUP BY 1, 2, 3) p USING (arquivo, iy, ix)
          WINDOW five AS (PARTITION BY arquivo, iy, ix, ano ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) q
    GROUP BY arquivo, iy, ix, ano"""


LONG_COLUMNS = "wet_days, sdii, rx1day, rx5day, r20mm, r50mm, r95ptot_mm, r95ptot_frac"
LONG_CASTS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LONG_COLUMNS.split(", "))
UNIT_SQL = """CASE WHEN nome_indice IN ('wet_days', 'r20mm', 'r50mm') THEN 'dias' WHEN nome_indice = 'sdii' THEN 'mm/day'
    WHEN nome_indice = 'r95ptot_frac' THEN 'adimensional' ELSE 'mm' END"""


def long_sql(wide: str, ids: str) -> str:
    """Wide indices as one row per index."""
    return f"""SELECT {ids}, nome_indice, valor, {UNIT_SQL} AS unidade
    FROM (SELECT {ids}, {LONG_CASTS} FROM {wide}) UNPIVOT INCLUDE NULLS (valor FOR nome_indice IN ({LONG_COLUMNS}))"""


view("indices_runs", indices_sql("grid_pr_runs"), "grid_pr_runs")
view("long_runs", long_sql("indices_runs", "arquivo, iy, ix, lat, lon, ano"), "indices_runs")
view(
    "grid_pr_runs_gaps",
    "SELECT * REPLACE (CASE WHEN (iy * 10 + ix + ano) % 7 = 0 THEN NULL ELSE valor END AS valor) FROM grid_pr_runs",
    "grid_pr_runs",
)
view("indices_runs_gaps", indices_sql("grid_pr_runs_gaps"), "grid_pr_runs_gaps")
view("long_runs_gaps", long_sql("indices_runs_gaps", "arquivo, iy, ix, lat, lon, ano"), "indices_runs_gaps")
view(
    "results",
    """SELECT 'exec_' || substr(l.arquivo, 4, 1) || '_' || l.iy || '_' || l.ix || '_' || l.ano || '_' || l.nome_indice AS id,
    'exec_' || substr(l.arquivo, 4, 1) AS execucao_id, l.lat, l.lon, l.ano, l.nome_indice, l.valor, l.unidade, c.municipio_id
    FROM long_runs_gaps l LEFT JOIN cells c USING (iy, ix)""",
    "long_runs_gaps",
    "cells",
)


def run_of_file() -> Column:
    """Run id of a file of ``grid_pr_runs``."""
    return F.concat(F.lit("exec_"), F.substring("arquivo", 4, 1))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per return flag."""
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").groupBy(flag).agg(
        F.min("l_shipdate").alias("criado_em"), F.max("l_shipdate").alias("concluido_em"),
        F.count(F.lit(1)).alias("n"),
    ).select(
        F.concat(F.lit("exec_"), flag).alias("id"),
        F.when(flag == "N", F.lit("rcp45")).otherwise(F.lit("rcp85")).alias("cenario"),
        F.lit("pr").alias("variavel"),
        F.concat(F.lit("pr_"), flag, F.lit(".nc")).alias("arquivo_origem"),
        F.lit("grade").alias("tipo"),
        F.concat(F.lit('{"freq_thr_mm":"20","linhas":"'), F.col("n").cast("string"), F.lit('"}')).alias("parametros"),
        F.when(flag == "R", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.col("criado_em").cast("timestamp").alias("criado_em"),
        F.col("concluido_em").cast("timestamp").alias("concluido_em"),
        F.lit(None).cast("string").alias("job_id"),
    )


view(
    "runs",
    """SELECT 'exec_' || l_returnflag AS id, CASE WHEN l_returnflag = 'N' THEN 'rcp45' ELSE 'rcp85' END AS cenario,
    'pr' AS variavel, 'pr_' || l_returnflag || '.nc' AS arquivo_origem, 'grade' AS tipo,
    '{"freq_thr_mm":"20","linhas":"' || count(*) || '"}' AS parametros,
    CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status,
    min(l_shipdate) AS criado_em, max(l_shipdate) AS concluido_em FROM lineitem GROUP BY l_returnflag""",
)


def municipalities(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as municipalities, regions as UFs."""
    k = F.col("n_nationkey")
    return (
        table(spark, sf, "nation")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.cast("bigint").alias("id"), F.col("n_name").alias("nome"),
            X.normalize_city(F.col("n_name")).alias("nome_normalizado"),
            F.substring("r_name", 1, 2).alias("uf"),
            (F.lit(-29.875) + F.floor(k / 5) * 0.5).alias("lat_centroide"),
            (F.lit(-59.75) + k % 5).alias("lon_centroide"),
            F.lit(None).cast("timestamp").alias("atualizado_em"),
        )
    )


view(
    "municipalities",
    """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS nome, lower(n_name) AS nome_normalizado, substr(r_name, 1, 2) AS uf,
    CAST(-29.875 AS DOUBLE) + CAST(n_nationkey // 5 AS DOUBLE) / 2 AS lat_centroide,
    CAST(-59.75 AS DOUBLE) + n_nationkey % 5 AS lon_centroide FROM nation JOIN region ON n_regionkey = r_regionkey""",
)


# --- suppliers and names ----------------------------------------------------


def supplier_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Import lines from parts: many repeats, some lines broken."""
    k = F.col("p_partkey") % 17
    return table(spark, sf, "part").select(
        F.when(k == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\t"))).alias("nome"),
        F.when(k == 1, F.lit("")).otherwise(F.col("p_brand")).alias("cidade"),
        F.when(k == 2, F.lit("?")).otherwise(F.lower(F.substring("p_type", 1, 2))).alias("uf"),
        (F.col("p_partkey") + 2).alias("numero_linha"),
    )


view(
    "supplier_batch",
    """SELECT CASE p_partkey % 17 WHEN 0 THEN '' ELSE p_name END AS nome, CASE p_partkey % 17 WHEN 1 THEN '' ELSE p_brand END AS cidade,
    CASE p_partkey % 17 WHEN 2 THEN '?' ELSE upper(substr(p_type, 1, 2)) END AS uf, p_partkey + 2 AS numero_linha FROM part""",
)


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers already stored: the key of every third part."""
    kept = F.col("p_partkey") % 3 == 0
    return (
        table(spark, sf, "part")
        .filter(kept)
        .groupBy(F.col("p_name").alias("nome"), F.col("p_brand").alias("cidade"), F.upper(F.substring("p_type", 1, 2)).alias("uf"))
        .agg(F.min("p_partkey").alias("k"))
        .select(
            F.concat(F.lit("forn_"), F.col("k").cast("string")).alias("id"), "nome", "cidade", "uf",
            F.timestamp_seconds(F.lit(946684800) + (F.col("k") % 50) * 86400).alias("criado_em"),
        )
    )


view(
    "suppliers",
    """SELECT 'forn_' || min(p_partkey) AS id, p_name AS nome, p_brand AS cidade, upper(substr(p_type, 1, 2)) AS uf,
    TIMESTAMP '2000-01-01' + to_days(CAST(min(p_partkey) % 50 AS INTEGER)) AS criado_em
    FROM part WHERE p_partkey % 3 = 0 GROUP BY 2, 3, 4""",
)


def name_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as municipality names of a UF each type stands for."""
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_name").alias("nome"), F.upper(F.substring("p_type", 1, 2)).alias("uf"))
        .agg(F.min("p_partkey").alias("id"))
        .select(
            "id", "nome", X.normalize_city(F.col("nome")).alias("nome_normalizado"), "uf",
            (F.col("id") / 4).alias("lat_centroide"), (F.col("id") / 8).alias("lon_centroide"),
        )
    )


view(
    "name_catalog",
    """SELECT min(p_partkey) AS id, p_name AS nome, p_name AS nome_normalizado, upper(substr(p_type, 1, 2)) AS uf,
    CAST(min(p_partkey) AS DOUBLE) / 4 AS lat_centroide, CAST(min(p_partkey) AS DOUBLE) / 8 AS lon_centroide FROM part GROUP BY 2, 4""",
)


def name_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as typed by a user: accents and capitals, hyphens, a slip, one word, a longer name, none."""
    name, k = F.col("p_name"), F.col("p_partkey") % 7
    typed = (
        F.when(k == 1, F.upper(F.translate(name, "ae", "áé")))
        .when(k == 2, F.concat(F.lit("  "), F.translate(name, " ", "-")))
        .when(k == 3, F.concat(F.substring(name, 1, 2), F.substr(name, F.lit(4))))
        .when(k == 4, F.substring_index(name, " ", 1))
        .when(k == 5, F.concat(F.substring_index(name, " ", -1), F.lit(" "), F.substring_index(name, " ", 1)))
        .when(k == 6, F.when(F.col("p_size") > 25, F.lit(" ")).otherwise(F.concat(name, F.lit(" qwxz"))))
        .otherwise(name)
    )
    uf = F.when(F.col("p_size") == 7, F.lit("zz")).otherwise(F.lower(F.substring("p_type", 1, 2)))
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("identificador"), typed.alias("cidade"), uf.alias("uf")
    )


view(
    "name_inputs",
    """SELECT CAST(p_partkey AS VARCHAR) AS identificador,
    CASE p_partkey % 7 WHEN 1 THEN upper(translate(p_name, 'ae', 'áé')) WHEN 2 THEN '  ' || replace(p_name, ' ', '-')
      WHEN 3 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 4 THEN split_part(p_name, ' ', 1)
      WHEN 5 THEN split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1)
      WHEN 6 THEN CASE WHEN p_size > 25 THEN ' ' ELSE p_name || ' qwxz' END ELSE p_name END AS cidade,
    CASE WHEN p_size = 7 THEN 'ZZ' ELSE upper(substr(p_type, 1, 2)) END AS uf,
    CASE p_partkey % 7 WHEN 3 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 4 THEN split_part(p_name, ' ', 1)
      WHEN 5 THEN split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1)
      WHEN 6 THEN CASE WHEN p_size > 25 THEN '' ELSE p_name || ' qwxz' END ELSE p_name END AS alvo FROM part""",
)

_RATIO = "100.0::DOUBLE * (1.0::DOUBLE - (2 * levenshtein({a}, {b}) - abs(length({a}) - length({b})))::DOUBLE / (length({a}) + length({b}))::DOUBLE)"
_SORTED = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"
_STRETCH = "greatest(length(a), length(b))::DOUBLE / least(length(a), length(b))::DOUBLE"
SCORE_SQL = f"""greatest({_RATIO.format(a='a', b='b')},
    CASE WHEN {_STRETCH} < 1.5 THEN greatest(0.95::DOUBLE * {_RATIO.format(a=_SORTED.format(x='a'), b=_SORTED.format(x='b'))},
           CASE WHEN list_has_all(string_split(a, ' '), string_split(b, ' ')) OR list_has_all(string_split(b, ' '), string_split(a, ' ')) THEN 95.0::DOUBLE ELSE 0.0::DOUBLE END)
         WHEN {_STRETCH} <= 8 THEN CASE WHEN contains(a, b) OR contains(b, a) THEN 90.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END)"""

view("asked_names", "SELECT DISTINCT uf, alvo FROM name_inputs WHERE alvo <> ''", "name_inputs")
view(
    "fuzzy_pairs",
    f"""SELECT * FROM (SELECT uf, a, b, id, {SCORE_SQL} AS score
      FROM (SELECT n.uf, n.alvo AS a, c.nome_normalizado AS b, c.id FROM asked_names n JOIN name_catalog c USING (uf)))
    WHERE score >= 90""",
    "asked_names",
    "name_catalog",
)
view(
    "resolved",
    """SELECT n.uf, n.alvo, c.id, c.nome, c.lat_centroide, c.lon_centroide, 'cache_exato' AS how
    FROM asked_names n JOIN name_catalog c ON n.uf = c.uf AND n.alvo = c.nome_normalizado
    UNION ALL SELECT f.uf, f.a, c.id, c.nome, c.lat_centroide, c.lon_centroide, 'cache_fuzzy'
    FROM (SELECT *, row_number() OVER (PARTITION BY uf, a ORDER BY score DESC, b, id) AS n FROM fuzzy_pairs) f
    JOIN name_catalog c ON c.id = f.id AND c.uf = f.uf
    WHERE f.n = 1 AND NOT EXISTS (SELECT 1 FROM name_catalog e WHERE e.uf = f.uf AND e.nome_normalizado = f.a)""",
    "fuzzy_pairs",
    "name_catalog",
    "asked_names",
)
view(
    "geocoded",
    """SELECT i.identificador, i.cidade, i.uf, r.id AS municipio_id, r.nome AS nome_canonico, r.lat_centroide AS lat, r.lon_centroide AS lon,
    CASE WHEN i.uf NOT IN (SELECT uf FROM name_catalog) THEN 'uf_sem_catalogo' ELSE coalesce(r.how, 'nao_encontrado') END AS metodo
    FROM name_inputs i LEFT JOIN resolved r ON i.uf = r.uf AND i.alvo = r.alvo""",
    "name_inputs",
    "resolved",
)
