"""Queries on stored results and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.place_queries import P
from checks.rain_queries import results
from checks.registry import query, scratch
from checks.stress_queries import _NAMED, _STORED, some_municipalities, stored
from garoa.functions import text as X
from garoa.operators import results as R
from garoa.operators import spatial
from garoa.operators.sizing import keep
from garoa.params import Aggregation, Page, ResultFilter, StressFilter
from garoa.plans import result_queries as Q
from garoa.sinks import published as V
from garoa.sinks import tables as T

_ROW = "id, execucao_id, lat, lon, ano, nome_indice, round(valor, 6) AS valor, unidade, municipio_id"


def rows(df):
    return df.select(
        "id", "execucao_id", "lat", "lon", "ano", "nome_indice", F.round("valor", 6).alias("valor"), "unidade", "municipio_id"
    )


def filtered(f: ResultFilter):
    """Query that filters the bound results."""
    return lambda spark, sf: rows(
        R.filter_results(results(spark, sf), f, B.runs(spark, sf), B.municipalities(spark, sf))
    )


_FILTERS = {
    "results_by_run_year_and_index": (
        ResultFilter(execucao_id="exec_A", ano=1997, nomes_indices=("sdii", "rx5day")),
        "execucao_id = 'exec_A' AND ano = 1997 AND nome_indice IN ('sdii', 'rx5day')",
    ),
    "results_by_scenario_variable_and_uf": (
        ResultFilter(cenario="rcp85", variavel="pr", ano_min=1996, ano_max=1999, uf="AF"),
        """execucao_id IN (SELECT id FROM runs WHERE cenario = 'rcp85' AND variavel = 'pr') AND ano BETWEEN 1996 AND 1999
        AND municipio_id IN (SELECT id FROM municipalities WHERE uf = 'AF')""",
    ),
    "results_by_municipality_and_box": (
        ResultFilter(municipio_id=7, lat_min=-30.0, lat_max=-28.0, lon_min=300.0, lon_max=304.0),
        "municipio_id = 7 AND lat BETWEEN -30 AND -28 AND lon BETWEEN 300 AND 304",
    ),
    "results_by_box_across_antimeridian": (
        ResultFilter(lat_min=-30.0, lat_max=-28.0, lon_min=303.5, lon_max=301.0),
        "lat BETWEEN -30 AND -28 AND (lon >= 303.5 OR lon <= 301)",
    ),
    "results_in_radius": (
        ResultFilter(raio_km=120.0, centro_lat=-29.0, centro_lon=-58.1, ano_min=1998),
        """ano >= 1998 AND abs(lat + 29) <= 120 / 111.0::DOUBLE AND abs(((lon + 58.1 + 180) % 360) - 180) <= 120 / (111.0::DOUBLE * cos(radians(-29)))
        AND 6371.0 * 2 * asin(sqrt(sin(radians(lat + 29) / 2) ^ 2 + cos(radians(-29)) * cos(radians(lat)) * sin(radians(lon + 58.1) / 2) ^ 2)) <= 120""",
    ),
}
for _name, (_f, _where) in _FILTERS.items():
    query(f"SELECT {_ROW} FROM results WHERE {_where}", "results", "runs", "municipalities", name=_name)(filtered(_f))


@query(
    "SELECT r.id, r.execucao_id, u.cenario, u.variavel FROM results r JOIN runs u ON r.execucao_id = u.id WHERE u.status = 'completed'",
    "results",
    "runs",
)
def results_with_run(spark, sf):
    runs = R.filter_runs(B.runs(spark, sf), status="completed")
    return R.join_run(results(spark, sf), runs).select("id", "execucao_id", "cenario", "variavel")


@query(
    "SELECT r.id, r.municipio_id, m.nome AS nome_municipio, m.uf FROM results r JOIN municipalities m ON r.municipio_id = m.id WHERE m.uf <> 'EU'",
    "results",
    "municipalities",
)
def results_with_municipality(spark, sf):
    return R.join_municipality(results(spark, sf), some_municipalities(spark, sf)).select(
        "id", "municipio_id", "nome_municipio", "uf"
    )


# --- aggregations -----------------------------------------------------------

_SQL_FN = {
    "media": ("avg(valor)", "count(valor)"),
    "min": ("min(valor)", "count(valor)"),
    "max": ("max(valor)", "count(valor)"),
    "count": ("CAST(count(*) AS DOUBLE)", "count(*)"),
    "p50": ("quantile_cont(valor, 0.5)", "count(valor)"),
    "p95": ("quantile_cont(valor, 0.95)", "count(valor)"),
}
_SQL_DIM = {"ano": "r.ano", "nome_indice": "r.nome_indice", "municipio": "r.municipio_id", "cenario": "u.cenario", "variavel": "u.variavel"}


def _aggregated(name: str, fn: str, dims: tuple[str, ...], f: ResultFilter = ResultFilter(), where: str = "true") -> None:
    value, n = _SQL_FN[fn]
    keys = "".join(f"{_SQL_DIM[d]} AS {d}, " for d in dims)
    group = f" GROUP BY {', '.join(_SQL_DIM[d] for d in dims)}" if dims else ""
    sql = f"SELECT {keys}round({value}, 6) AS valor, {n} AS n_amostras FROM results r JOIN runs u ON r.execucao_id = u.id WHERE {where}{group}"

    @query(sql, "results", "runs", name=name)
    def aggregated(spark, sf):
        read = results(spark, sf)
        stored = keep(read) if fn.startswith("p") else read
        out = Q.aggregate(stored, Aggregation(fn, dims), f, B.runs(spark, sf), B.municipalities(spark, sf))
        return out.withColumn("valor", F.round("valor", 6))


_aggregated("mean_by_index_and_year", "media", ("nome_indice", "ano"))
_aggregated("minimum_by_municipality", "min", ("municipio", "nome_indice"))
_aggregated("maximum_by_scenario", "max", ("cenario", "variavel", "nome_indice"))
_aggregated("count_by_scenario_filtered", "count", ("cenario", "ano"), ResultFilter(cenario="rcp85"), "u.cenario = 'rcp85'")
_aggregated("global_mean", "media", ())
_aggregated("global_mean_of_nothing", "media", (), ResultFilter(ano=1900), "r.ano = 1900")
_aggregated("median_by_index_and_scenario", "p50", ("nome_indice", "cenario"))
_aggregated("p95_by_index_and_year", "p95", ("ano", "nome_indice"))
_aggregated("p95_by_municipality", "p95", ("municipio",))
_aggregated("global_median", "p50", ())
_NEAR = """abs(r.lat + 29) <= 150 / 111.0::DOUBLE AND abs(((r.lon + 58.1 + 180) % 360) - 180) <= 150 / (111.0::DOUBLE * cos(radians(-29)))
    AND 6371.0 * 2 * asin(sqrt(sin(radians(r.lat + 29) / 2) ^ 2 + cos(radians(-29)) * cos(radians(r.lat)) * sin(radians(r.lon + 58.1) / 2) ^ 2)) <= 150"""
_CIRCLE = ResultFilter(raio_km=150.0, centro_lat=-29.0, centro_lon=-58.1)
_aggregated("mean_in_radius", "media", ("cenario", "nome_indice"), _CIRCLE, _NEAR)
_aggregated("p95_in_radius", "p95", ("nome_indice",), _CIRCLE, _NEAR)


@query("SELECT ano, nome_indice, CAST(row_number() OVER (ORDER BY ano NULLS FIRST, nome_indice) AS INTEGER) AS n FROM (SELECT DISTINCT ano, nome_indice FROM results)", "results")
def group_order(spark, sf):
    """Groups numbered in the order in which they come, which is that of their keys."""
    out = Q.aggregate(results(spark, sf), Aggregation("count", ("ano", "nome_indice")))
    return R.numbered(out.select("ano", "nome_indice"))


# --- vocabularies and counters ----------------------------------------------


def _distinct(dim: str, sql: str) -> None:
    @query(sql, "results", "runs", name=f"distinct_{dim}")
    def distinct(spark, sf):
        return R.distinct_values(results(spark, sf), dim, B.runs(spark, sf))


_distinct("ano", "SELECT DISTINCT ano FROM results")
_distinct("nome_indice", "SELECT DISTINCT nome_indice FROM results")
_distinct("cenario", "SELECT DISTINCT cenario FROM runs WHERE id IN (SELECT execucao_id FROM results)")
_distinct("variavel", "SELECT DISTINCT variavel FROM runs WHERE id IN (SELECT execucao_id FROM results)")


@query("SELECT count(DISTINCT execucao_id) AS total_execucoes_com_resultados, count(*) AS total_resultados FROM results", "results")
def result_counters(spark, sf):
    return R.result_counters(results(spark, sf))


@query(
    """SELECT (SELECT string_agg(DISTINCT cenario, ',' ORDER BY cenario) FROM runs WHERE id IN (SELECT execucao_id FROM results)) AS cenarios,
    (SELECT string_agg(DISTINCT CAST(ano AS VARCHAR), ',' ORDER BY CAST(ano AS VARCHAR)) FROM results) AS anos,
    (SELECT string_agg(DISTINCT variavel, ',') FROM runs) AS variaveis,
    (SELECT string_agg(DISTINCT nome_indice, ',' ORDER BY nome_indice) FROM results) AS nomes_indices,
    (SELECT count(DISTINCT execucao_id) FROM results) AS total_execucoes_com_resultados, (SELECT count(*) FROM results) AS total_resultados""",
    "results",
    "runs",
)
def stats_summary(spark, sf):
    out = R.stats_summary(results(spark, sf), B.runs(spark, sf))
    lists = ("cenarios", "anos", "variaveis", "nomes_indices")
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})


@query(
    "SELECT (SELECT count(*) FROM suppliers) AS fornecedores, (SELECT count(*) FROM municipalities) AS municipios, (SELECT count(*) FROM runs) AS execucoes",
    "suppliers",
    "municipalities",
    "runs",
)
def entity_counters(spark, sf):
    return R.entity_counters(B.suppliers(spark, sf), B.municipalities(spark, sf), B.runs(spark, sf))


@query(
    f"SELECT {_ROW} FROM results ORDER BY execucao_id, ano, nome_indice, id LIMIT 200 OFFSET 500", "results"
)
def page_results(spark, sf):
    page, _ = Q.query_results(results(spark, sf), ResultFilter(), Page(200, 500))
    return rows(page)


@query("SELECT count(*) AS total FROM results WHERE nome_indice = 'sdii' AND valor IS NOT NULL OR nome_indice = 'sdii' AND valor IS NULL", "results")
def count_results(spark, sf):
    _, total = Q.query_results(results(spark, sf), ResultFilter(nomes_indices=("sdii",)), Page())
    return total


@query("SELECT id, cenario, status FROM runs WHERE cenario = 'rcp85' AND variavel = 'pr' AND status = 'completed'", "runs")
def filter_runs(spark, sf):
    return R.filter_runs(B.runs(spark, sf), "rcp85", "pr", "completed").select("id", "cenario", "status")


@query("SELECT id FROM runs ORDER BY criado_em DESC, id LIMIT 2", "runs")
def page_runs(spark, sf):
    return R.page_runs(B.runs(spark, sf), Page(2)).select("id")


@query(
    "SELECT 'exec_' || l_returnflag AS id, '20' AS limiar, CAST(count(*) AS VARCHAR) AS linhas, '{\"freq_thr_mm\":\"20\",\"linhas\":\"' || count(*) || '\"}' AS texto FROM lineitem GROUP BY l_returnflag",
)
def run_parameters(spark, sf):
    read = B.runs(spark, sf).select("id", X.run_params(F.col("parametros")).alias("p"))
    return read.select("id", F.col("p")["freq_thr_mm"].alias("limiar"), F.col("p")["linhas"].alias("linhas"), X.params_json(F.col("p")).alias("texto"))


# --- sinks: write, then read back -------------------------------------------


@query(f"SELECT {_ROW} FROM results", "results")
def write_results(spark, sf):
    path = scratch(spark, "results")
    T.write_results(results(spark, sf), path)
    return rows(spark.read.parquet(path))


@query(
    "SELECT execucao_id, count(*) AS linhas FROM results WHERE execucao_id <> 'exec_R' GROUP BY 1", "results"
)
def replace_runs(spark, sf):
    path = scratch(spark, "runs")
    out = results(spark, sf)
    T.write_results(out, path)
    again = out.filter("execucao_id = 'exec_A'")
    T.replace_runs(again, path)
    T.replace_run(out.filter("ano < 0"), path, "exec_R")
    return spark.read.parquet(path).groupBy("execucao_id").agg(F.count(F.lit(1)).alias("linhas"))


@query(
    f"SELECT {_ROW} FROM results WHERE execucao_id <> 'exec_R' AND (execucao_id <> 'exec_A' OR ano >= 1996 OR ano < 1994)", "results"
)
def published_runs(spark, sf):
    path, out = scratch(spark, "published"), results(spark, sf)
    V.publish_runs(out, path)
    V.publish_runs(out.filter("execucao_id = 'exec_A' AND ano >= 1996"), path, runs=("exec_R",))
    V.publish_runs(out.filter("execucao_id = 'exec_A' AND ano < 1994"), path, replace=False)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return rows(V.read_runs(spark, path, kinds))


_EXPORT = f"""SELECT id, execucao_id, CAST(municipio_id AS VARCHAR) AS municipio_id, nome_municipio, uf, CAST(ano AS VARCHAR) AS ano, cenario,
    CAST(frequencia_dias_secos_quentes AS VARCHAR) AS frequencia_dias_secos_quentes, intensidade_mm_dia FROM ({_NAMED}) WHERE ano >= 1996"""


@query(_EXPORT, "stress", "municipalities")
def export_csv(spark, sf):
    path = scratch(spark, "export")
    Q.export_stress(stored(spark, sf), some_municipalities(spark, sf), StressFilter(ano_min=1996), path)
    back = spark.read.csv(path, header=True)
    return back.withColumn("intensidade_mm_dia", F.col("intensidade_mm_dia").cast("double"))


@query(_EXPORT, "stress", "municipalities")
def export_json(spark, sf):
    path = scratch(spark, "export")
    Q.export_stress(stored(spark, sf), some_municipalities(spark, sf), StressFilter(ano_min=1996), path, "json")
    kinds = ", ".join(f"{c} {'double' if c == 'intensidade_mm_dia' else 'string'}" for c in T.EXPORT_COLUMNS)
    return spark.read.schema(kinds).json(path)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS k, p_name || '", ;' || chr(10) || p_brand AS texto FROM part""")
def export_table_csv(spark, sf):
    path = scratch(spark, "table")
    text = F.concat("p_name", F.lit('", ;\n'), "p_brand")
    T.export_table_csv(B.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.alias("texto")), path)
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)


@query(f"SELECT count(*) AS total FROM ({_STORED})", "stress")
def export_limit(spark, sf):
    return R.count_rows(T.check_export_limit(stored(spark, sf), 200_000))


@query(
    f"""SELECT c.iy, c.ix, min(b.municipio_id) AS municipio_id, 'bound' AS grid_id FROM (SELECT *, ((lon + 180) % 360) - 180 AS x FROM cells) c
    JOIN boxes b ON {B.inside_sql('c.x', 'c.lat')} GROUP BY 1, 2""",
    "cells",
    "boxes",
)
def stored_cell_map(spark, sf):
    path = scratch(spark, "cell-map")

    def build():
        return spatial.map_cells(B.cells(spark, sf), B.edges(spark, sf))

    T.cell_map_for(spark, path, "bound", build)
    return T.cell_map_for(spark, path, "bound", build)


@query("SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS ano, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    keyed = B.table(spark, sf, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("ano"))
    return T.duplicate_keys(keyed, ["l_suppkey", "ano"])


@query(
    """SELECT g.identificador, r.m IS NOT NULL AS tem_cobertura FROM geocoded g LEFT JOIN (SELECT DISTINCT municipio_id AS m FROM results) r ON g.municipio_id = r.m""",
    "geocoded",
    "results",
)
def coverage_join(spark, sf):
    from garoa.operators import geocode as G

    items = G.geocode(B.name_inputs(spark, sf).withColumn("uf_entrada", F.col("uf")), B.name_catalog(spark, sf))
    held = R.municipalities_with_results(items.select("municipio_id").filter("municipio_id IS NOT NULL"), results(spark, sf))
    return P.coverage_join(items, held).select("identificador", "tem_cobertura")
