"""Readers and writers on small files."""

from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from garoa import errors as E
from garoa.operators import rain, spatial
from garoa.params import Page
from garoa.sinks import published as V
from garoa.sinks import tables as T
from garoa.sources import grid as G
from garoa.sources import places as L


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return str(path)


LONG = "time timestamp_ntz, latitude double, longitude double, pr float, units string"


def days(spark, value=1.0):
    import datetime as dt

    return [(dt.datetime(2030, 1, 1 + d), la, lo, value, "mm/day") for d in range(2) for la in (2.0, 1.0) for lo in (10.0, 11.0)]


def test_read_grid_names_index_and_scenario(spark, tmp_path):
    path = write(spark, tmp_path / "pr_RCP85_x", days(spark), LONG)
    grid = G.read_grid(spark, path, "pr")
    rows = grid.collect()
    assert {(r["iy"], r["ix"], r["lat"], r["lon"]) for r in rows} == {(0, 0, 1.0, 10.0), (0, 1, 1.0, 11.0), (1, 0, 2.0, 10.0), (1, 1, 2.0, 11.0)}
    assert {r["cenario"] for r in rows} == {"rcp85"} and {r["ano"] for r in rows} == {2030}
    assert rows[0]["arquivo"] == "pr_RCP85_x"


def test_missing_columns_fail_without_a_job(spark):
    df = spark.createDataFrame(days(spark), LONG)
    with pytest.raises(E.MissingVariableError):
        G.as_grid(df, "tas")
    with pytest.raises(E.GridReadError):
        G.as_grid(df.drop("latitude"), "pr")
    with pytest.raises(E.GridReadError):
        G.as_grid(df.drop("time"), "pr")
    with pytest.raises(E.MissingVariableError):
        G.main_variable(["height", "time_bnds", "x"])
    assert G.main_variable(["height", "tas", "pr"]) == "tas"


def test_folder_rules(spark, tmp_path):
    folder = tmp_path / "pr"
    write(spark, folder, days(spark), LONG)
    assert G.read_grid_folder(spark, str(folder), "pr", " RCP45 ").select("cenario").distinct().head()[0] == "rcp45"
    (tmp_path / "empty").mkdir()
    with pytest.raises(E.EmptyFolderError):
        G.read_grid_folder(spark, str(tmp_path / "empty"), "pr", "rcp45")
    other = tmp_path / "attrs"
    spark.createDataFrame(days(spark), LONG).withColumn("experiment_id", F.lit("RCP85")).write.parquet(str(other))
    with pytest.raises(E.InconsistentScenarioError):
        G.read_grid_folder(spark, str(other), "pr", "rcp45")
    named = tmp_path / "named"
    write(spark, named, days(spark), LONG)
    for file in named.glob("*.parquet"):
        file.rename(named / f"pr_ssp585_{file.name}")
    for crc in named.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(E.InconsistentScenarioError):
        G.read_grid_folder(spark, str(named), "pr", "rcp45")
    # Another climate variable in the slot is read all the same.
    assert G.read_grid_folder(spark, str(folder), "evspsbl", "rcp45").select("variavel").distinct().head()[0] == "pr"


def test_mesh_and_fingerprint(spark):
    lat = spark.createDataFrame([(0, 1.0), (1, 2.0)], "iy int, lat double")
    lon = spark.createDataFrame([(0, 5.0), (1, 6.0), (2, 7.0)], "ix int, lon double")
    mesh = spatial.mesh_axes(lat, lon)
    assert mesh.count() == 6 and mesh.filter("iy = 1 AND ix = 2").head()["lon"] == 7.0

    def digest(df):
        return spatial.grid_fingerprint(df).head()[0]

    assert digest(mesh) == digest(mesh.orderBy(F.desc("ix")).repartition(5)) and len(digest(mesh)) == 16
    assert digest(mesh) == digest(mesh.withColumn("lat", F.col("lat") + 1e-7))
    assert digest(mesh) != digest(mesh.withColumn("lat", F.col("lat") + 1e-4))
    assert digest(mesh) != digest(mesh.selectExpr("ix AS iy", "iy AS ix", "lat", "lon"))


CSV = "Empresa;Município;ESTADO;extra\nAna;São Paulo;SP;1\n;;;\n\"Bia; Cia\";Lapa;PR;2\n"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_supplier_csv(spark, tmp_path, encoding):
    path = tmp_path / "f.csv"
    path.write_bytes(CSV.encode(encoding))
    lines = L.read_suppliers_csv(spark, str(path), ";", "ISO-8859-1" if encoding == "latin-1" else "UTF-8")
    rows = [tuple(r) for r in lines.orderBy("numero_linha").collect()]
    assert rows == [("Ana", "São Paulo", "SP", 2), ("Bia; Cia", "Lapa", "PR", 4)]


def test_supplier_csv_counts_blank_records_and_quoted_line_ends(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('nome,cidade,uf\nAna,Lapa,SP\n\n"Bia\nCia",Lapa,"P""R"\nDea,Lapa,RS\n')
    rows = [tuple(r) for r in L.read_suppliers_csv(spark, str(path)).orderBy("numero_linha").collect()]
    assert rows == [("Ana", "Lapa", "SP", 2), ("Bia\nCia", "Lapa", 'P"R', 4), ("Dea", "Lapa", "RS", 5)]
    records = L.csv_records(spark.read.text(str(path)), block=2)
    assert [r.numero_linha for r in records.orderBy("numero_linha").collect()] == [1, 2, 3, 4, 5]


def test_supplier_csv_takes_a_stray_quote_as_a_character(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('nome,cidade,uf\nLoja 5",Recife,PE\nAna,Lapa,SP\n"Bia"s,"Lapa\n2",PR\nDea,Lapa,RS\n')
    rows = [tuple(r) for r in L.read_suppliers_csv(spark, str(path)).orderBy("numero_linha").collect()]
    assert rows == [('Loja 5"', "Recife", "PE", 2), ("Ana", "Lapa", "SP", 3), ("Bias", "Lapa\n2", "PR", 4), ("Dea", "Lapa", "RS", 5)]


@pytest.mark.parametrize("sep", [",", ";", "|"])
def test_csv_records_are_those_of_the_csv_reader(spark, tmp_path, sep):
    draw = random.Random(ord(sep))
    lines = ["".join(draw.choice(f'ab""{sep}') for _ in range(draw.randint(0, 7))) for _ in range(600)] + ['"', "z"]
    path = tmp_path / "f.csv"
    path.write_text("\n".join(lines) + "\n")
    records = L.csv_records(spark.read.text(str(path)), block=7, sep=sep)
    found = {r.numero_linha: r.cells for r in records.select("numero_linha", L.csv_cells(F.col("record"), sep).alias("cells")).collect()}
    with path.open(newline="") as f:
        expected = [[c.removesuffix("\n") for c in r] or [""] for r in csv.reader(f, delimiter=sep)]
    found = [[c.removesuffix("\n") for c in found[i + 1]] for i in range(len(found))]
    assert found == expected


def test_table_without_file_names_gets_its_units(spark):
    rows = [("2001-01-01", 0.0, 0.0, 0.001)]
    df = spark.createDataFrame(rows, "time string, lat double, lon double, pr double")
    assert rain.to_mm_day_by_file(G.as_grid(df, "pr")).first()["valor"] == pytest.approx(86.4)


def test_exports_of_any_size_unless_limited(spark, tmp_path):
    n = 200_001
    rows = spark.range(n).selectExpr(
        "cast(id AS string) AS id", "'e' AS execucao_id", "id AS municipio_id", "'m' AS nome_municipio", "'SP' AS uf",
        "2000 AS ano", "'rcp45' AS cenario", "1 AS frequencia_dias_secos_quentes", "0.5D AS intensidade_mm_dia",
    )
    T.export_results(rows, str(tmp_path / "all"))
    assert spark.read.csv(str(tmp_path / "all"), header=True).count() == n
    with pytest.raises(E.ExportLimitError):
        T.export_results(rows, str(tmp_path / "some"), max_rows=n - 1)
    assert Page(5000).limit == 5000
    with pytest.raises(E.ValidationError):
        Page(5000, most=1000)


def test_supplier_csv_without_headers_is_empty(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("nome,cidade\nAna,Lapa\n")
    assert L.read_suppliers_csv(spark, str(path)).count() == 0


def test_line_numbers_over_many_partitions(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.col("id"))
    assert L.number_lines(df, "n", 2).filter(F.col("n") != F.col("id") + 2).count() == 0
    spread = spark.range(0, 900_000, 3, 5).withColumnRenamed("id", "l")
    assert L.number_lines_by(spread, "l", "n").filter(F.col("n") != F.col("l") / 3 + 1).count() == 0


def test_city_lists(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("  São Paulo/sp \n\nrodapé\nA/B/ rj\n/SP\nX/\n\tOlinda / PE\n")
    rows = [tuple(r) for r in L.read_city_list(spark, str(path)).collect()]
    assert sorted(rows) == sorted([("São Paulo/sp", "São Paulo", "SP"), ("A/B/ rj", "A/B", "RJ"), ("Olinda / PE", "Olinda", "PE")])
    path = tmp_path / "ids.txt"
    path.write_text("F1;Lapa/pr\nOlinda/PE\n;Natal/RN\nA/B/RJ\nF2;Sem barra\nNada/XYZ\nF3; Recife / PE;x\n")
    rows = {r["numero_linha"]: (r["identificador"], r["cidade"], r["uf"]) for r in L.read_city_list_with_id(spark, str(path)).collect()}
    assert rows == {1: ("F1", "Lapa", "PR"), 2: ("linha-2", "Olinda", "PE"), 3: ("linha-3", "Natal", "RN")}


def square(x, y, r=0.2):
    return [[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r], [x - r, y - r]]


def test_geojson_polygons(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"CD_MUN": "3550308", "SIGLA_UF": "SP"}, "geometry": {"type": "Polygon", "coordinates": [square(-46.63, -23.55)]}},
        {"type": "Feature", "properties": {"CD_GEOCMU": 3304557}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(-43.2, -22.9)], [square(-43.2, -22.0), square(-43.2, -22.0, 0.1)]]}},
        {"type": "Feature", "properties": {"id": "7"}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [square(0, 0)]}]}},
    ]
    whole = tmp_path / "all.geojson"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    lines = tmp_path / "lines.geojson"
    lines.write_text("\n".join(json.dumps(f) for f in features))
    one, many = L.read_municipality_polygons(spark, str(whole)), L.read_municipality_polygons(spark, str(lines), False)
    assert one.count() == 20 and one.drop("feature").exceptAll(many.drop("feature")).isEmpty()
    points = spark.createDataFrame([(-23.5, -46.6), (-22.0, -43.2), (-22.15, -43.2), (0.1, 0.1)], "lat double, lon double")
    found = {r["lat"]: r["municipio_id"] for r in spatial.locate_points(points, one).collect()}
    assert found == {-23.5: 3550308, -22.0: None, -22.15: 3304557, 0.1: 7}
    with pytest.raises(E.ConfigurationError):
        L.polygon_columns(["id", "UF"])
    assert L.polygon_columns(["UF", "NM_MUN", "id", "CD_MUN"]) == {"id": "CD_MUN", "uf": "UF", "nome": "NM_MUN"}


def test_catalog(spark, tmp_path):
    good = {"id": 1, "nome": "A", "microrregiao": {"mesorregiao": {"UF": {"sigla": "SP"}}}}
    path = tmp_path / "cat.json"
    path.write_text(json.dumps([good, {"id": 2, "nome": "B", "microrregiao": None}]))
    assert [tuple(r) for r in L.read_municipality_catalog(spark, str(path), strict=False).collect()] == [(1, "A", "SP")]
    with pytest.raises(Exception, match="malformed"):
        L.read_municipality_catalog(spark, str(path)).collect()


# --- sinks ------------------------------------------------------------------


def results(spark, run, n):
    return spark.range(n).select(F.lit(run).alias("execucao_id"), F.lit(2000).alias("ano"), F.lit("sdii").alias("nome_indice"), F.col("id").cast("double").alias("valor"))


def test_rerun_replaces_only_its_run(spark, tmp_path):
    path = str(tmp_path / "r")
    T.write_results(results(spark, "a", 5).unionByName(results(spark, "b", 3)), path)
    for _ in range(2):
        T.replace_runs(results(spark, "a", 2), path)
    T.replace_run(results(spark, "b", 4), path, "b")

    def counts():
        return {r["execucao_id"]: r["count"] for r in spark.read.parquet(path).groupBy("execucao_id").count().collect()}

    assert counts() == {"a": 2, "b": 4}
    T.replace_run(results(spark, "a", 0), path, "a")
    assert counts() == {"b": 4}
    with pytest.raises(E.ValidationError):
        T.replace_run(results(spark, "a", 1), path, "../x")
    assert "PartitionFilters: [isnotnull(execucao_id" in spark.read.parquet(path).filter("execucao_id = 'b'")._jdf.queryExecution().executedPlan().toString()


_RUN = "execucao_id string, ano int, nome_indice string, valor double"


def published(spark, path):
    return {r["execucao_id"]: r["count"] for r in V.read_runs(spark, path, _RUN).groupBy("execucao_id").count().collect()}


@pytest.mark.parametrize("pairs", [10_000, 0])
def test_published_runs_change_whole(spark, tmp_path, monkeypatch, pairs):
    monkeypatch.setattr(V, "BROADCAST_PAIRS", pairs)
    path = str(tmp_path / "p")
    assert published(spark, path) == {} and V.stale_versions(spark, path).count() == 0
    V.publish_runs(results(spark, "001", 5).unionByName(results(spark, "b", 3)), path)
    V.publish_runs(results(spark, "001", 2), path, replace=False)
    V.publish_runs(results(spark, "c", 1), path, replace=False)
    assert published(spark, path) == {"001": 7, "b": 3, "c": 1} and V.stale_versions(spark, path).count() == 0
    V.publish_runs(results(spark, "001", 4), path, runs=("c",))
    assert published(spark, path) == {"001": 4, "b": 3}
    V.publish_runs(results(spark, "b", 0), path, runs=("b",))
    assert published(spark, path) == {"001": 4} and V.stale_versions(spark, path).count() == 3


def test_failed_publication_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    V.publish_runs(results(spark, "a", 5), path)
    broken = results(spark, "a", 1000).repartition(4).withColumn(
        "valor", F.when(F.col("valor") == 999, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("valor"))
    )
    with pytest.raises(Exception, match="lost"):
        V.publish_runs(broken, path)
    with pytest.raises(E.ValidationError):
        V.publish_runs(results(spark, None, 2), path)
    assert published(spark, path) == {"a": 5}
    V.publish_runs(results(spark, "a", 6), path)
    assert published(spark, path) == {"a": 6}


def test_readers_scan_live_folders_only(spark, tmp_path):
    path = str(tmp_path / "p")
    for n in range(3):
        V.publish_runs(results(spark, "a", n + 1), path)
    read = V.read_runs(spark, path, _RUN)
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 3


def test_limits_and_keys(spark):
    df = results(spark, "a", 5)
    assert T.check_export_limit(df, 5) is df
    with pytest.raises(E.ExportLimitError):
        T.check_export_limit(df, 4)
    with pytest.raises(E.DuplicateKeyError):
        T.assert_unique(df, ["ano"])
    assert T.assert_unique(df, ["ano", "valor"]) is df


def test_cell_map_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(0, 0, 1)], "iy int, ix int, municipio_id long")

    for _ in range(3):
        stored = T.cell_map_for(spark, str(tmp_path / "m"), "abc", build)
    T.cell_map_for(spark, str(tmp_path / "m"), "def", build)
    assert len(calls) == 2 and stored.head()["grid_id"] == "abc"


def test_bound_grids_move_once(spark, tmp_path, monkeypatch):
    """Lines are dealt by cell once, for the sums, the join with the cells and the windows; lines of a crowded cell are combined first."""
    from checks import bindings as B
    from checks.rain_queries import results as indices
    from garoa.operators import sizing

    day = (F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 400).cast("int"))).alias("l_shipdate")
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).cast("bigint")
    flag = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") % 3 + 1).cast("int"))
    lines = spark.range(6000).select(key.alias("l_suppkey"), day, flag.alias("l_returnflag"), (F.col("id") % 60).cast("double").alias("l_quantity"), F.lit(0.05).alias("l_discount"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    sf, old = str(tmp_path), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        whole = indices(spark, sf)
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(iy#") == 1, plan
        monkeypatch.setattr(sizing, "ROWS_OF_KEY", 1000)
        combined = indices(spark, sf)
        assert "REPARTITION_BY_COL" not in combined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, combined.collect())) == sorted(map(repr, whole.collect()))
        assert B.grid_pr(spark, sf).agg(F.sum("valor")).head()[0] == lines.filter("l_suppkey is not null").agg(F.sum("l_quantity")).head()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
