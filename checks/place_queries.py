"""Queries on polygons, names, suppliers and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.rain_queries import results
from checks.registry import query
from garoa.functions import numeric as N
from garoa.functions import text as X
from garoa.operators import geocode as G
from garoa.operators import municipalities as M
from garoa.operators import results as R
from garoa.operators import spatial
from garoa.operators import suppliers as U
from garoa.params import Page
from garoa.plans import places_jobs as P
from garoa.sources import places as L

_EDGES = """SELECT municipio_id, 0 AS part, ring, k, x1, y1, x2, y2 FROM (
    SELECT municipio_id, 0 AS ring, unnest([0, 1, 2, 3]) AS k, unnest([x0, x0 + 1, x0 + 1, x0]) AS x1, unnest([y0, y0, y0 + 0.5, y0 + 0.5]) AS y1,
      unnest([x0 + 1, x0 + 1, x0, x0]) AS x2, unnest([y0, y0 + 0.5, y0 + 0.5, y0]) AS y2 FROM boxes
    UNION ALL
    SELECT municipio_id, 1, unnest([0, 1, 2, 3]), unnest([x0 + 0.5, x0 + 0.875, x0 + 0.875, x0 + 0.5]), unnest([y0 + 0.25, y0 + 0.25, y0 + 0.4375, y0 + 0.4375]),
      unnest([x0 + 0.875, x0 + 0.875, x0 + 0.5, x0 + 0.5]), unnest([y0 + 0.25, y0 + 0.4375, y0 + 0.4375, y0 + 0.25]) FROM boxes WHERE hole)"""


@query(_EDGES, "boxes")
def polygon_edges(spark, sf):
    return B.edges(spark, sf)


@query(_EDGES, "boxes")
def geojson_polygons(spark, sf):
    whole = B.rings(spark, sf).groupBy("municipio_id").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ring", "coords"))), lambda r: r.coords)).alias("c")
    )
    none = F.lit(None).cast("array<struct<type:string,coordinates:string>>")
    features = whole.select(
        F.create_map(F.lit("CD_MUN"), F.col("municipio_id").cast("string")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.col("c").alias("coordinates"), none.alias("geometries")).alias("geometry"),
    )
    return spatial.ring_edges(L.require_id(L.geojson_rings(features)))


@query(
    "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS nome, substr(r_name, 1, 2) AS uf FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def municipality_catalog(spark, sf):
    named = B.municipalities(spark, sf)
    nested = named.select(
        "id", "nome",
        F.struct(F.struct(F.struct(F.col("uf").alias("sigla")).alias("UF")).alias("mesorregiao")).alias("microrregiao"),
    )
    return L.flatten_catalog(nested)


@query(
    f"""SELECT ponto_id, p.lat, p.lon, min(b.municipio_id) AS municipio_id, min(b.municipio_id) IS NOT NULL AS encontrado
    FROM points p LEFT JOIN boxes b ON {B.inside_sql('p.lon', 'p.lat')} GROUP BY 1, 2, 3""",
    "points",
    "boxes",
)
def locate_points(spark, sf):
    return spatial.locate_points(B.points(spark, sf), B.edges(spark, sf))


@query(
    f"""SELECT count(*) AS total, count(m) AS encontrados, count(*) - count(m) AS nao_encontrados FROM (
    SELECT ponto_id, min(b.municipio_id) AS m FROM points p LEFT JOIN boxes b ON {B.inside_sql('p.lon', 'p.lat')} GROUP BY 1)""",
    "points",
    "boxes",
)
def locate_summary(spark, sf):
    return spatial.locate_summary(spatial.locate_points(B.points(spark, sf), B.edges(spark, sf)))


@query(
    f"""SELECT ponto_id, p.lat, p.lon, min(b.municipio_id) AS municipio_id, min(b.municipio_id) IS NOT NULL AS encontrado
    FROM points p LEFT JOIN (SELECT * FROM boxes UNION ALL SELECT municipio_id, x0 + 0.4375, y0 + 0.1875, hole FROM boxes) b
      ON {B.inside_sql('p.lon', 'p.lat')} GROUP BY 1, 2, 3""",
    "points",
    "boxes",
)
def locate_points_in_overlapping_features(spark, sf):
    rings = B.rings(spark, sf)
    moved = F.transform("coords", lambda c: F.array(c[0] + 0.4375, c[1] + 0.1875))
    both = rings.withColumn("feature", F.lit("a")).unionByName(rings.withColumns({"coords": moved, "feature": F.lit("b")}))
    return spatial.locate_points(B.points(spark, sf), spatial.ring_edges(both))


_MAPPED = f"""SELECT c.iy, c.ix, min(b.municipio_id) AS municipio_id FROM (SELECT *, ((lon + 180) % 360) - 180 AS x FROM cells) c
    JOIN boxes b ON {B.inside_sql('c.x', 'c.lat')} GROUP BY 1, 2"""


@query(_MAPPED, "cells", "boxes")
def map_cells(spark, sf):
    return spatial.map_cells(B.cells(spark, sf), B.edges(spark, sf))


@query(
    f"""SELECT l.arquivo, l.iy, l.ix, l.ano, l.nome_indice, round(l.valor, 6) AS valor, m.municipio_id
    FROM long_runs l LEFT JOIN ({_MAPPED}) m USING (iy, ix)""",
    "long_runs",
    "cells",
    "boxes",
)
def enrich_with_municipality(spark, sf):
    from checks.rain_queries import indices_long_form

    mapped = spatial.map_cells(B.cells(spark, sf), B.edges(spark, sf))
    return spatial.enrich_with_municipality(indices_long_form(spark, sf), mapped).drop("unidade")


@query(
    """SELECT municipio_id, CASE WHEN hole THEN y0 + 0.21875 ELSE y0 + 0.25 END AS lat, x0 + 0.5 AS lon FROM (SELECT *  REPLACE (false AS hole) FROM boxes WHERE NOT hole)
    UNION ALL SELECT municipio_id, y0 + 0.34375, x0 + 0.25 FROM boxes WHERE hole""",
    "boxes",
)
def representative_point(spark, sf):
    return spatial.representative_point(B.edges(spark, sf))


@query(
    """SELECT ponto_id, round(6371.0 * 2 * asin(sqrt(sin(radians(lat + 28) / 2) ^ 2 + cos(radians(-28)) * cos(radians(lat)) * sin(radians(lon + 58) / 2) ^ 2)), 6) AS km,
    round(lat - 250 / 111.0::DOUBLE, 6) AS lat_min, round(lat + 250 / 111.0::DOUBLE, 6) AS lat_max,
    round(lon - 250 / (111.0::DOUBLE * greatest(cos(radians(lat)), 0.01)), 6) AS lon_min, round(lon + 250 / (111.0::DOUBLE * greatest(cos(radians(lat)), 0.01)), 6) AS lon_max FROM points""",
    "points",
)
def haversine_and_box(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    box = N.bbox_from_radius(lat, lon, F.lit(250.0))
    return B.points(spark, sf).select(
        "ponto_id", F.round(N.haversine_km(F.lit(-28.0), F.lit(-58.0), lat, lon), 6).alias("km"),
        *[F.round(side, 6).alias(name) for name, side in box.items()],
    )


# --- names ------------------------------------------------------------------


@query(
    """SELECT p_partkey, 'd' || 'avila ' || p_name || ' doeste cao ' || lower(replace(p_type, '-', ' ')) || ' ' || p_size AS chave FROM part""",
)
def normalize_city(spark, sf):
    raw = F.concat(F.lit("  D’Ávila  "), F.initcap("p_name"), F.lit("-D´OESTE\tÇão "), F.col("p_type"), F.lit("-"), F.col("p_size").cast("string"))
    return B.table(spark, sf, "part").select("p_partkey", X.normalize_city(raw).alias("chave"))


@query(
    """SELECT n.uf, n.alvo, c.id FROM asked_names n LEFT JOIN name_catalog c ON n.uf = c.uf AND n.alvo = c.nome_normalizado""",
    "asked_names",
    "name_catalog",
)
def geocode_exact(spark, sf):
    return G.geocode_exact(_asked(spark, sf), B.name_catalog(spark, sf)).select("uf", "alvo", "m.id")


def _asked(spark, sf):
    return (
        B.name_inputs(spark, sf)
        .select(F.upper("uf").alias("uf"), X.normalize_city(F.col("cidade")).alias("alvo"))
        .filter("alvo <> ''")
        .distinct()
    )


@query("SELECT uf, a, b, round(score, 6) AS score FROM fuzzy_pairs", "fuzzy_pairs")
def fuzzy_pairs(spark, sf):
    pairs = G.fuzzy_pairs(_asked(spark, sf), B.name_catalog(spark, sf))
    return pairs.withColumn("score", F.round("score", 6))


@query(
    """SELECT uf, a AS alvo, b AS nome_normalizado, id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY uf, a ORDER BY score DESC, b, id) AS n FROM fuzzy_pairs) WHERE n = 1""",
    "fuzzy_pairs",
)
def geocode_fuzzy(spark, sf):
    best = G.geocode_fuzzy(_asked(spark, sf), B.name_catalog(spark, sf))
    return best.select(
        "uf", "alvo", X.normalize_city(F.col("m.nome")).alias("nome_normalizado"), "m.id", F.round("score", 6).alias("score")
    )


@query("SELECT * REPLACE (CAST(identificador AS VARCHAR) AS identificador) FROM geocoded", "geocoded")
def geocode_job(spark, sf):
    # The SQL holds the upper-case UF; inputs keep theirs.
    out = G.geocode(B.name_inputs(spark, sf), B.name_catalog(spark, sf))
    return out.withColumn("uf", F.upper("uf"))


@query(
    """SELECT count(*) AS total, count(municipio_id) AS encontrados, count(*) - count(municipio_id) AS nao_encontrados FROM geocoded""",
    "geocoded",
)
def geocode_summary(spark, sf):
    return G.geocode_summary(G.geocode(B.name_inputs(spark, sf), B.name_catalog(spark, sf)))


_COVERED = """SELECT g.identificador, g.cidade AS cidade_entrada, g.uf AS uf_entrada, r.m IS NOT NULL AS tem_cobertura, g.municipio_id, g.nome_canonico,
    CASE WHEN g.municipio_id IS NULL THEN 'municipio_nao_geocodificado' WHEN r.m IS NULL THEN 'sem_dados_climaticos' END AS motivo_nao_encontrado
    FROM geocoded g LEFT JOIN (SELECT DISTINCT municipio_id AS m FROM results) r ON g.municipio_id = r.m"""


@query(_COVERED, "geocoded", "results")
def coverage_job(spark, sf):
    out = P.coverage(B.name_inputs(spark, sf), B.name_catalog(spark, sf), results(spark, sf))
    return out.withColumn("uf_entrada", F.upper("uf_entrada"))


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE tem_cobertura) AS com_cobertura,
    count(*) FILTER (WHERE NOT tem_cobertura) AS sem_cobertura FROM ({_COVERED})""",
    "geocoded",
    "results",
)
def coverage_summary(spark, sf):
    return P.coverage_summary(P.coverage(B.name_inputs(spark, sf), B.name_catalog(spark, sf), results(spark, sf)))


@query(
    "SELECT id AS municipio_id FROM name_catalog WHERE id IN (SELECT municipio_id FROM results)", "name_catalog", "results"
)
def municipalities_with_results(spark, sf):
    ids = B.name_catalog(spark, sf).select(F.col("id").alias("municipio_id"))
    return R.municipalities_with_results(ids, results(spark, sf))


# --- lists and suppliers ----------------------------------------------------

@query(
    """SELECT identificador, cidade, uf FROM (SELECT p_name || '/' || p_brand || ' / ' || lower(p_type) AS identificador,
    p_name || '/' || p_brand AS cidade, p_type AS uf FROM part WHERE p_partkey % 5 <> 0)""",
)
def city_list(spark, sf):
    part = B.table(spark, sf, "part")
    full = F.concat(F.lit("\t "), F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit(" / "), F.lower("p_type"), F.lit("  "))
    bare = F.col("p_partkey") % 5 == 0
    broken = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat(F.lit(" /"), F.col("p_type")))
    return L.parse_city_list(part.select(F.when(bare, broken).otherwise(full).alias("value")))


@query(
    """SELECT numero_linha, CASE WHEN com_id THEN 'F' || numero_linha ELSE 'linha-' || row_number() OVER (ORDER BY numero_linha) END AS identificador,
    cidade, uf FROM (SELECT p_partkey + 1 AS numero_linha, p_partkey % 3 = 0 AS com_id, p_name AS cidade, upper(substr(p_type, 1, 2)) AS uf
    FROM part WHERE p_size % 10 <> 0)""",
)
def city_list_with_id(spark, sf):
    line = F.col("p_partkey") + 1
    place = F.concat(F.col("p_name"), F.lit(" / "), F.lower(F.substring("p_type", 1, F.when(F.col("p_size") % 10 == 0, 3).otherwise(2))))
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" F"), line.cast("string"), F.lit(";"), place)).otherwise(place)
    return L.parse_city_list_with_id(B.table(spark, sf, "part").select(line.alias("numero_linha"), value.alias("value")))


@query(
    """SELECT p_name AS nome, p_brand AS cidade, p_type AS uf, p_partkey + 2 AS numero_linha FROM part""",
)
def supplier_lines(spark, sf):
    named = B.table(spark, sf, "part").select(
        F.col("p_brand").alias(" Município "), F.col("p_name").alias("RAZAO SOCIAL"), F.col("p_type").alias("Estado"),
        F.col("p_name").alias("empresa"),
    )
    return L.supplier_lines(named)


@query("SELECT nome, cidade, uf, numero_linha FROM supplier_batch", "supplier_batch")
def clean_supplier(spark, sf):
    return U.clean_supplier(B.supplier_batch(spark, sf))


_LABELLED = """SELECT b.numero_linha, b.nome, b.cidade, b.uf, CASE WHEN b.motivo IS NOT NULL THEN 'erro'
      WHEN s.nome IS NULL AND b.numero_linha = min(b.numero_linha) FILTER (WHERE b.motivo IS NULL) OVER (PARTITION BY b.nome, b.cidade, b.uf) THEN 'importado'
      ELSE 'duplicado' END AS status, b.motivo
    FROM (SELECT *, CASE WHEN nome = '' THEN 'nome vazio' WHEN cidade = '' THEN 'cidade vazia' WHEN length(uf) <> 2 THEN 'uf inválida (esperado 2 letras)' END AS motivo
      FROM supplier_batch) b LEFT JOIN suppliers s ON s.nome = b.nome AND s.cidade = b.cidade AND s.uf = b.uf"""


@query(_LABELLED, "supplier_batch", "suppliers")
def import_suppliers(spark, sf):
    _, labelled = P.import_suppliers(B.supplier_batch(spark, sf), B.suppliers(spark, sf))
    return labelled


@query(
    _LABELLED.replace("FROM supplier_batch)", "FROM (SELECT * FROM supplier_batch UNION ALL SELECT nome, CASE WHEN cidade = '' THEN '' ELSE cidade || ' X' END, uf, numero_linha FROM supplier_batch))"),
    "supplier_batch",
    "suppliers",
)
def import_suppliers_of_two_files(spark, sf):
    """Two files whose lines have the same numbers."""
    batch = B.supplier_batch(spark, sf)
    other = batch.withColumn("cidade", F.when(F.col("cidade") == "", "").otherwise(F.concat("cidade", F.lit(" X"))))
    _, labelled = P.import_suppliers(batch.unionByName(other), B.suppliers(spark, sf))
    return labelled


@query(
    f"SELECT nome, cidade, uf, 'forn_' || substr(md5(nome || '|' || cidade || '|' || uf), 1, 26) AS id FROM ({_LABELLED}) WHERE status = 'importado'",
    "supplier_batch",
    "suppliers",
)
def imported_supplier_rows(spark, sf):
    rows, _ = P.import_suppliers(B.supplier_batch(spark, sf), B.suppliers(spark, sf))
    return rows.select("id", "nome", "cidade", "uf")


@query(
    f"""SELECT count(*) AS total_linhas, count(*) FILTER (WHERE status = 'importado') AS importados,
    count(*) FILTER (WHERE status = 'duplicado') AS duplicados, count(*) FILTER (WHERE status = 'erro') AS erros FROM ({_LABELLED})""",
    "supplier_batch",
    "suppliers",
)
def import_summary(spark, sf):
    return U.import_summary(U.label_lines(B.supplier_batch(spark, sf), B.suppliers(spark, sf)))


@query(
    """SELECT nome, cidade, uf, min(numero_linha) AS numero_linha FROM supplier_batch WHERE nome <> '' AND cidade <> '' AND length(uf) = 2 GROUP BY 1, 2, 3""",
    "supplier_batch",
)
def first_lines(spark, sf):
    checked = U.refusal(U.clean_supplier(B.supplier_batch(spark, sf)))
    return U.first_lines(checked.filter("motivo IS NULL"))


@query(
    """SELECT b.* FROM supplier_batch b WHERE NOT EXISTS (SELECT 1 FROM suppliers s WHERE s.nome = b.nome AND s.cidade = b.cidade AND s.uf = b.uf)""",
    "supplier_batch",
    "suppliers",
)
def new_suppliers(spark, sf):
    out = U.new_suppliers(U.clean_supplier(B.supplier_batch(spark, sf)), B.suppliers(spark, sf))
    return out.select("nome", "cidade", "uf", "numero_linha")


@query("SELECT id, nome, cidade, uf FROM suppliers WHERE uf = 'EC' AND cidade = 'Brand#2'", "suppliers")
def filter_suppliers(spark, sf):
    return U.filter_suppliers(B.suppliers(spark, sf), "ec", "Brand#2").drop("criado_em")


@query(
    "SELECT id, nome, cidade, uf FROM suppliers ORDER BY criado_em DESC, id LIMIT 40 OFFSET 10", "suppliers"
)
def page_suppliers(spark, sf):
    return U.page_suppliers(B.suppliers(spark, sf), Page(40, 10)).drop("criado_em")


# --- municipality dimension -------------------------------------------------


@query("SELECT id, nome, uf FROM municipalities WHERE uf = 'AF' AND nome_normalizado = 'nation_10'", "municipalities")
def lookup_municipality(spark, sf):
    return M.filter_municipalities(B.municipalities(spark, sf), "AF", "nation_10").select("id", "nome", "uf")


@query(
    "SELECT id, nome FROM municipalities ORDER BY nome_normalizado, id LIMIT 10 OFFSET 5", "municipalities"
)
def page_municipalities(spark, sf):
    return M.page_municipalities(B.municipalities(spark, sf), Page(10, 5)).select("id", "nome")


_UPSERT = """SELECT id, nome, uf FROM municipalities WHERE id NOT IN (SELECT CAST(s_suppkey % 40 AS BIGINT) FROM supplier)
    UNION ALL SELECT id, nome, 'NV' FROM (SELECT CAST(s_suppkey % 40 AS BIGINT) AS id, max_by(s_name, s_suppkey) AS nome FROM supplier GROUP BY 1)"""


@query(_UPSERT, "municipalities")
def upsert_municipalities(spark, sf):
    new = B.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 40).alias("id"), F.col("s_name").alias("nome"), F.lit("NV").alias("uf"), F.col("s_suppkey").alias("ordem")
    )
    return M.upsert_municipalities(B.municipalities(spark, sf).select("id", "nome", "uf"), new)


@query(
    """SELECT id, nome, nome_normalizado, uf, CASE WHEN id % 3 = 0 THEN lat_centroide + 0.09375 ELSE lat_centroide END AS lat_centroide,
    CASE WHEN id % 3 = 0 THEN lon_centroide - 0.25 ELSE lon_centroide END AS lon_centroide FROM municipalities""",
    "municipalities",
)
def municipality_dim_job(spark, sf):
    dim = B.municipalities(spark, sf)
    old = dim.filter("uf = 'AS'").withColumn("nome", F.lit("antigo"))
    out = P.build_municipality_dim(old, dim.select("id", "nome", "uf"), B.edges(spark, sf))
    return out.drop("atualizado_em")


@query(
    "SELECT count(*) AS total, count(*) FILTER (WHERE uf <> 'AS') AS com_centroide, count(*) FILTER (WHERE uf = 'AS') AS sem_centroide FROM municipalities",
    "municipalities",
)
def catalog_summary(spark, sf):
    dim = B.municipalities(spark, sf)
    return M.catalog_summary(dim.withColumn("lat_centroide", F.when(F.col("uf") != "AS", F.col("lat_centroide"))))
