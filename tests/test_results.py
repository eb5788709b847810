"""Filters, aggregations, percentiles and pages over stored results."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from garoa.errors import ValidationError
from garoa.operators import results as R
from garoa.operators.municipalities import upsert_municipalities
from garoa.operators.quantile import group_percentile
from garoa.params import Aggregation, BBox, Page, ResultFilter, StressFilter
from garoa.plans import result_queries as Q

SCHEMA = "id string, execucao_id string, lat double, lon double, ano int, nome_indice string, valor double, municipio_id long"
ROWS = [
    ("1", "a", -23.5, -46.6, 2030, "sdii", 10.0, 1),
    ("2", "a", -23.5, -46.6, 2031, "sdii", None, 1),
    ("3", "a", -22.9, -43.2, 2030, "rx1day", 50.0, 2),
    ("4", "b", 10.0, 179.5, 2030, "sdii", 20.0, None),
    ("5", "b", 10.0, -179.5, 2031, "sdii", 40.0, 3),
    ("6", "zz", 0.0, 0.0, 2030, "sdii", 1.0, 9),
]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([("a", "rcp45", "pr", "completed"), ("b", "rcp85", "pr", "failed"), ("c", "ssp1", "tas", "completed")], "id string, cenario string, variavel string, status string")


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(1, "x", "SP"), (2, "y", "RJ"), (3, "z", "SP")], "id long, nome string, uf string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("f,want", [
    (ResultFilter(), "123456"),
    (ResultFilter(cenario="rcp45"), "123"),
    (ResultFilter(variavel="pr", ano=2030), "134"),
    (ResultFilter(ano_min=2031), "25"),
    (ResultFilter(uf="SP"), "125"),
    (ResultFilter(nomes_indices=("rx1day",), municipio_id=2), "3"),
    (ResultFilter(lat_min=-24, lat_max=-23, lon_min=-47, lon_max=-46), "12"),
    (ResultFilter(lat_min=9, lat_max=11, lon_min=179, lon_max=-179), "45"),
    (ResultFilter(raio_km=120, centro_lat=10.0, centro_lon=179.9), "45"),
    (ResultFilter(raio_km=50, centro_lat=10.0, centro_lon=179.9), "4"),
    (ResultFilter(raio_km=30000, centro_lat=0.0, centro_lon=0.0), "123456"),
])
def test_filters(stored, runs, dim, f, want):
    assert ids(R.filter_results(stored, f, runs, dim)) == list(want)


def test_argument_rules():
    for bad in (dict(ano=2030, ano_min=2029), dict(ano_min=3, ano_max=2), dict(raio_km=5.0), dict(raio_km=0.0, centro_lat=1.0, centro_lon=1.0)):
        with pytest.raises(ValidationError):
            ResultFilter(**bad)
    for limit, offset, most in ((0, 0, None), (1001, 0, 1000), (5, -1, None)):
        with pytest.raises(ValidationError):
            Page(limit, offset, most)
    for bad in (lambda: Aggregation("soma"), lambda: Aggregation("media", ("uf",)), lambda: BBox(2, 1, 0, 0), lambda: StressFilter(ano=1, ano_max=2)):
        with pytest.raises(ValidationError):
            bad()


def test_aggregations(stored, runs, dim):
    def run(fn, dims=(), f=ResultFilter()):
        return [tuple(r) for r in Q.aggregate(stored, Aggregation(fn, dims), f, runs, dim).collect()]

    assert run("media", ("cenario",)) == [("rcp45", 30.0, 2), ("rcp85", 30.0, 2)]
    assert run("count", ("cenario",), ResultFilter(cenario="rcp45")) == [("rcp45", 3.0, 3)]
    assert run("max", ("municipio",))[0] == (None, 20.0, 1)
    assert run("min", ("ano",)) == [(2030, 1.0, 4), (2031, 40.0, 1)]
    assert run("media", (), ResultFilter(ano=1900)) == [(None, 0)]
    assert run("count", (), ResultFilter(ano=1900)) == [(0.0, 0)]
    assert run("p50", (), ResultFilter(ano=1900)) == []
    nowhere = ResultFilter(raio_km=1.0, centro_lat=80.0, centro_lon=0.0)
    assert run("media", (), nowhere) == [] and run("count", (), nowhere) == []
    assert run("p50", ("municipio",), ResultFilter(ano=2031, execucao_id="a")) == [(1, None, 0)]
    assert run("p95", ("variavel",)) == [("pr", statistics.quantiles([10, 50, 20, 40], n=100, method="inclusive")[94], 4)]


@pytest.mark.parametrize("q", [0.5, 0.95])
def test_percentile_equals_quantiles(spark, q):
    rng = random.Random(8)
    groups = {
        "wide": [rng.uniform(-1, 1) * 10 ** rng.uniform(-12, 12) for _ in range(501)],
        "hot": [0.0] * 4000 + [float(rng.randint(-3, 3)) for _ in range(300)],
        "one": [7.25], "two": [1.0, 2.0], "near": [1 + i * 1e-13 for i in range(200)], "neg": [-float(i) for i in range(1, 60)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), (None, 3.0), ("two", None)]
    rng.shuffle(rows)
    got = {r["g"]: (r["valor"], r["n_amostras"]) for r in group_percentile(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], q).collect()}
    assert got.pop("none") == (None, 0) and got.pop(None) == (3.0, 1)
    for k, vs in groups.items():
        want = vs[0] if len(vs) == 1 else statistics.quantiles(vs, n=100, method="inclusive")[round(q * 100) - 1]
        assert got[k][0] == pytest.approx(want, rel=1e-9, abs=1e-15) and got[k][1] == len(vs)


@pytest.mark.parametrize("fn", ["media", "p50", "count"])
def test_groups_come_in_ascending_key_order(spark, fn):
    rows = [(f"i{k % 3}", 2000 + k * 7 % 11 if k % 5 else None, float(k)) for k in range(200)]
    table = spark.createDataFrame(rows, "nome_indice string, ano int, valor double").repartition(7)
    table = table.withColumn("municipio_id", F.lit(1).cast("bigint"))
    got = [(r.ano, r.nome_indice) for r in Q.aggregate(table, Aggregation(fn, ("ano", "nome_indice"))).collect()]
    assert got == sorted(set(got), key=lambda g: (g[0] is not None, g)) and len(got) > 20


def test_vocabularies_and_counters(spark, stored, runs):
    row = R.stats_summary(stored, runs).head()
    assert row["cenarios"] == ["rcp45", "rcp85"] and row["anos"] == [2030, 2031] and row["variaveis"] == ["pr"]
    assert (row["nomes_indices"], row["total_execucoes_com_resultados"], row["total_resultados"]) == (["rx1day", "sdii"], 3, 6)
    empty = R.stats_summary(stored.limit(0), runs).head()
    assert empty["anos"] == [] and empty["total_resultados"] == 0
    assert [r[0] for r in R.municipalities_with_results(spark.createDataFrame([(1,), (1,), (4,), (None,)], "municipio_id long"), stored).collect()] == [1]


def test_pages(stored):
    page, total = Q.query_results(stored, ResultFilter(), Page(2, 1))
    assert [r["id"] for r in page.collect()] == ["1", "2"] and total.head()[0] == 6
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()


def test_joins_only_when_needed(spark, stored, runs, dim, tmp_path):
    for name, df in (("r", stored), ("u", runs), ("d", dim)):
        df.write.parquet(str(tmp_path / name))
    r, u, d = (spark.read.parquet(str(tmp_path / n)) for n in "rud")

    def plan(f, with_run=False):
        return R.filter_results(r, f, u, d, with_run)._jdf.queryExecution().executedPlan().toString()

    alone = plan(ResultFilter(ano_min=2030, nomes_indices=("sdii",), lat_min=-24, lat_max=0, lon_min=-50, lon_max=0))
    assert "Join" not in alone and "PushedFilters: [" in alone
    assert plan(ResultFilter(cenario="rcp45"), True).count("BroadcastHashJoin") == 1
    assert plan(ResultFilter(cenario="rcp45", uf="SP")).count("BroadcastHashJoin") == 2


def test_upsert_last_wins(spark, dim):
    new = spark.createDataFrame([(3, "novo", "MG", 2), (3, "velho", "MG", 1), (4, "w", "BA", 1)], "id long, nome string, uf string, ordem int")
    out = {r["id"]: r["nome"] for r in upsert_municipalities(dim, new).collect()}
    assert out == {1: "x", 2: "y", 3: "novo", 4: "w"}


def test_export_orders_and_keeps_nulls(spark, dim, tmp_path):
    stress = spark.createDataFrame([("i2", "e", 9, 2031, "rcp45", 3, 1.5), ("i1", "e", 1, 2030, "rcp45", 2, 0.0)], "id string, execucao_id string, municipio_id long, ano int, cenario string, frequencia_dias_secos_quentes int, intensidade_mm_dia double")
    path = str(tmp_path / "out")
    Q.export_stress(stress, dim, StressFilter(), path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv"))).splitlines()
    assert text[0] == "id,execucao_id,municipio_id,nome_municipio,uf,ano,cenario,frequencia_dias_secos_quentes,intensidade_mm_dia"
    assert [t for t in text if not t.startswith("id,")] == ["i1,e,1,x,SP,2030,rcp45,2,0.0", "i2,e,9,,,2031,rcp45,3,1.5"]
    assert R.yearly_mean_frequency(stress.withColumn("ano", F.lit(2030))).head()["frequencia_media"] == 2.5


def test_percentile_of_values_in_one_narrow_bucket(spark):
    rows = spark.range(200_000).selectExpr("id % 2 AS k", "1.0D + id * 1e-8D AS v")
    rows = rows.unionByName(spark.createDataFrame([(0, float("inf")), (1, None)], "k long, v double"))
    out = {r.k: (r.valor, r.n_amostras) for r in group_percentile(rows, "v", ["k"], 0.5).collect()}
    even = np.append(1.0 + np.arange(0, 200_000, 2) * 1e-8, np.inf)
    odd = 1.0 + np.arange(1, 200_000, 2) * 1e-8
    assert out == {0: (np.quantile(even, 0.5), 100_001), 1: (pytest.approx(np.quantile(odd, 0.5), abs=1e-12), 100_000)}


def test_rows_are_numbered_in_the_order_they_have(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k")).repartition(7)
    for order, want in ((F.col("k").desc(), lambda k: 1000 - k), (F.col("k").asc(), lambda k: k + 1)):
        got = R.numbered(rows.orderBy(order)).collect()
        assert len(got) == 1000 and all(r.n == want(r.k) for r in got)
    assert R.numbered(rows.filter("k < 0")).count() == 0


def test_group_order_numbers_groups(spark, sf_dir):
    from checks.result_queries import group_order

    got = sorted(group_order(spark, sf_dir).collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, len(got) + 1)) and len(got) > 8
    assert [(r.ano, r.nome_indice) for r in got] == sorted((r.ano, r.nome_indice) for r in got)
