"""Skewed inputs, plan shapes and rules of the source."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from garoa.functions import text as X
from garoa.operators import geocode as G
from garoa.operators import results as R
from garoa.operators import sizing
from garoa.operators import spatial
from garoa.operators import stress as S
from garoa.operators import suppliers as U
from garoa.operators.quantile import group_percentile
from garoa.params import StressParams
from garoa.plans import stress_jobs

PACKAGE = Path(__file__).resolve().parent.parent / "garoa"
#: The corpus operators have rules of their own.
SOURCES = [p for p in PACKAGE.rglob("*.py") if "llm" not in p.parts]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def third(column, hot, other):
    """A value that a third of the rows share."""
    return F.when(F.col(column) % 3 == 0, hot).otherwise(other)


@pytest.mark.parametrize("word", ["localCheckpoint", "toPandas", "collect()", "crossJoin", ".rdd", "udf", "toLocalIterator", "foreach("])
def test_source_stays_distributed(word):
    for path in SOURCES:
        assert word not in path.read_text(), path


def test_head_is_only_for_errors_and_bounds():
    uses = [m for p in SOURCES for m in re.findall(r"\.(?:head|first|take)\(.*\)", p.read_text())]
    assert set(uses) <= {".head(1)"}


def test_large_tables_are_not_broadcast(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    hinted = spark.range(1000).withColumnRenamed("id", "k").join(sizing.broadcast_if_small(df, 100), "k")
    plain = spark.range(1000).withColumnRenamed("id", "k").join(sizing.broadcast_if_small(df, 99), "k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(hinted) and "BroadcastHashJoin" not in plan(plain)
        assert hinted.count() == plain.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.catalog.clearCache()


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Every join as at a size where nothing fits."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for module in ("garoa.operators.spatial", "garoa.operators.stress", "garoa.operators.geocode", "garoa.plans.places_jobs"):
        monkeypatch.setattr(f"{module}.broadcast_if_small", lambda df, *_: df)
    monkeypatch.setattr("garoa.operators.spatial.BROADCAST_LEAVES", 0)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_answers_without_any_broadcast(spark, no_broadcast):
    lat = spark.range(40).select((F.col("id") / 4 - 5).alias("lat"), F.col("id").cast("int").alias("iy"))
    cells = lat.select("iy", "lat", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("ix")).withColumn("lon", F.col("ix") / 4 - 6)
    points = spark.range(3000).select(
        F.col("id").alias("ponto_id"), third("id", F.lit(1.1), F.col("id") % 97 / 10 - 5).alias("lat"), third("id", F.lit(-2.2), F.col("id") % 89 / 9 - 5).alias("lon")
    )
    snapped = spatial.snap_to_grid(points, cells)
    assert "BroadcastHashJoin" not in plan(snapped) and snapped.count() == 3000
    assert snapped.filter("lat = 1.1").select("iy", "ix").distinct().collect() == [(24, 15)]
    far = snapped.filter((F.abs(F.col("lat_grid") - F.col("lat")) > 0.126) & (F.col("lat") < 4.7) | (F.abs(F.col("lon_grid") - F.col("lon")) > 0.126))
    assert far.count() == 0
    rings = spark.createDataFrame([(7, 0, 0, [[-3.0, 0.0], [0.0, 0.0], [0.0, 3.0], [-3.0, 3.0]])], "municipio_id long, part int, ring int, coords array<array<double>>")
    located = spatial.locate_points(points, spatial.ring_edges(rings))
    inside = (F.col("lat") > 0) & (F.col("lat") < 3) & (F.col("lon") > -3) & (F.col("lon") < 0)
    assert located.count() == 3000 and located.filter(F.col("encontrado") != inside).count() == 0


def test_hot_municipality_and_hot_file(spark):
    """A third of the cells belongs to one municipality, a third of the rows to one file."""
    grid = spark.range(90 * 60).select(
        F.lit("rcp45").alias("cenario"), F.explode(F.array(*[F.lit(v) for v in S.VARIABLES])).alias("variavel"),
        third("id", F.lit("a.nc"), F.concat(F.lit("b"), (F.col("id") % 7).cast("string"))).alias("arquivo"),
        F.timestamp_seconds((F.col("id") % 60) * 86400).cast("timestamp_ntz").alias("t"), F.lit(0).alias("iy"),
        F.floor(F.col("id") / 60).cast("int").alias("ix"), F.lit("").alias("units"),
    ).withColumn("valor", F.when(F.col("variavel") == "pr", 0.0).when(F.col("variavel") == "tas", 308.15).otherwise(4.0))
    cells = spark.range(90).select(
        F.explode(F.array(*[F.lit(v) for v in S.VARIABLES])).alias("variavel"), F.lit(0).alias("iy"), F.col("id").cast("int").alias("ix"), third("id", F.lit(1), F.col("id")).cast("bigint").alias("municipio_id"),
    )
    rows = stress_jobs.water_stress_run(grid, cells, StressParams(), F.lit("e")).collect()
    assert len(rows) == 60
    assert {(r["frequencia_dias_secos_quentes"], r["intensidade_mm_dia"]) for r in rows} == {(60, 4.0)}


def test_hot_names_and_hot_suppliers(spark):
    n = 9000
    dim = spark.createDataFrame([(1, "Curitiba", "PR"), (2, "Lapa", "PR")], "id long, nome string, uf string").withColumns(
        {"nome_normalizado": X.normalize_city(F.col("nome")), "lat_centroide": F.lit(0.0), "lon_centroide": F.lit(0.0)}
    )
    inputs = spark.range(n).select(F.col("id").alias("identificador"), third("id", F.lit("Curitba"), F.concat(F.lit("Lapa "), (F.col("id") % 50).cast("string"))).alias("cidade"), F.lit("pr").alias("uf"))
    out = G.geocode(inputs, dim)
    assert out.count() == n and out.filter("municipio_id = 1").count() == n // 3
    batch = spark.range(n).select(third("id", F.lit("Ana"), F.col("id").cast("string")).alias("nome"), F.lit("Lapa").alias("cidade"), F.lit("PR").alias("uf"), F.col("id").alias("numero_linha"))
    labelled = U.label_lines(batch, spark.createDataFrame([], "nome string, cidade string, uf string"))
    assert tuple(U.import_summary(labelled).head()) == (n, n - n // 3 + 1, n // 3 - 1, 0)
    assert "Window" not in plan(labelled)


def test_percentile_never_gathers_a_group(spark):
    df = spark.range(30_000).select(F.lit("g").alias("g"), third("id", F.lit(0.0), F.rand(4)).alias("v"))
    out = group_percentile(df, "v", ["g"], 0.5)
    assert "percentile" not in plan(out) and "collect_list" not in plan(out)
    want = df.agg(F.percentile("v", F.lit(0.5))).head()[0]
    assert out.head()["valor"] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("most", [None, 100])
def test_percentile_brackets_ranks_by_sketches(spark, monkeypatch, most):
    """A hot group, ties, NaN and infinity; with a low bound the brackets are sketched again."""
    from garoa.operators import quantile

    if most:
        monkeypatch.setattr(quantile, "MOST", most)
    odd = F.when(F.col("id") % 10 == 3, float("nan")).when(F.col("id") % 1000 == 8, float("inf")).when(F.col("id") % 1000 == 9, None)
    value = odd.when(F.col("g").isNull(), F.floor(F.rand(1) * 5)).otherwise(F.exp(F.randn(2) * 9))
    df = spark.range(60_000).withColumn("g", third("id", F.lit("hot"), F.when(F.col("id") % 7 > 0, (F.col("id") % 40).cast("string"))))
    df = df.select("g", value.alias("v"))
    df = df.persist()
    for q in (0.5,) if most else (0.05, 0.5, 1.0):
        got = {r.g: (repr(r.valor), r.n_amostras) for r in group_percentile(df, "v", ["g"], q).collect()}
        want = {r.g: (repr(r.p), r.n) for r in df.groupBy("g").agg(F.percentile("v", F.lit(q)).alias("p"), F.count("v").alias("n")).collect()}
        assert set(got) == set(want)
        for g, (p, n) in got.items():
            assert n == want[g][1] and (p == want[g][0] or float(p) == pytest.approx(float(want[g][0]), rel=1e-12)), (g, q)
        whole = group_percentile(df, "v", [], q).head()
        assert whole.n_amostras == df.filter("v is not null").count()
    df.unpersist()


def test_percentile_sorts_a_hundredth_of_a_group(spark):
    from garoa.operators import quantile

    df = spark.range(400_000).select(F.lit("g").alias("g"), F.rand(4).alias("v")).persist()
    out = group_percentile(df, "v", ["g"], 0.95)
    assert plan(out).count("Exchange hashpartitioning") <= 6 and out.count() == 1
    sums = df.groupBy("g").agg(F.count("v").alias("inside"), quantile._ladder(F.col("v")).alias("ladder"))
    rank = F.lit(0.95) * (F.col("inside") - 1)
    state = sums.select("g", F.lit(0).alias("below"), "inside", "ladder", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.floor(rank).alias("lo"), F.ceil(rank).alias("hi"))
    state = state.withColumn("hi", F.col("lo") + 1)
    low, high = state.select(*quantile._bounds(1)).head()
    assert df.filter((F.col("v") >= low) & (F.col("v") <= high)).count() < 400_000 * 0.02
    df.unpersist()


def test_sample_is_cut_before_the_shuffle(spark):
    cells = spark.range(5000).select(F.lit("pr").alias("variavel"), F.col("id").alias("municipio_id"))
    report = S.divergence_report(cells)
    assert "WindowGroupLimit" in plan(report)
    row = report.head()
    assert (row["categoria"], row["total"], row["amostra"]) == ("so_em_pr", 5000, list(range(10)))


def test_results_vocabulary_reads_the_table_once(spark, tmp_path):
    spark.range(100).select(F.lit("a").alias("execucao_id"), (F.col("id") % 5).cast("int").alias("ano"), F.lit("sdii").alias("nome_indice")).write.parquet(str(tmp_path / "r"))
    runs = spark.createDataFrame([("a", "rcp45", "pr")], "id string, cenario string, variavel string")
    row = R.stats_summary(spark.read.parquet(str(tmp_path / "r")), runs).head()
    assert row["anos"] == [0, 1, 2, 3, 4] and row["total_resultados"] == 100


def test_nothing_stays_kept_after_a_release(spark):
    spark.catalog.clearCache()
    for n in range(3):
        sizing.broadcast_if_small(spark.range(10 + n).withColumnRenamed("id", "k"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 3
    sizing.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
