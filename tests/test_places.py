"""Polygons, names, suppliers, coverage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from garoa.errors import ValidationError
from garoa.functions import text as X
from garoa.operators import geocode as G
from garoa.operators import spatial
from garoa.operators import suppliers as U
from garoa.plans import places_jobs as P

# Names and their comparison keys.
NAMES = {
    "São Paulo": "sao paulo",
    "FLORIANÓPOLIS": "florianopolis",
    "rio de janeiro": "rio de janeiro",
    "Ção-Ção": "cao cao",
    "Ñoño": "nono",
    "Vitória": "vitoria",
    "Alta Floresta D'Oeste": "alta floresta doeste",
    "Alvorada d'Oeste": "alvorada doeste",
    "Espigão D'OESTE": "espigao doeste",
    "D’Ávila": "davila",
    "Santa Bárbara d’Oeste": "santa barbara doeste",
    "São João del-Rei": "sao joao del rei",
    "Mogi-Mirim": "mogi mirim",
    "  Curitiba  ": "curitiba",
    "Belo  Horizonte": "belo horizonte",
    "\tBelo Horizonte\n": "belo horizonte",
    "São Paulo": "sao paulo",
    "": "",
    "   ": "",
}


def test_normalize_city_and_idempotence(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    key = X.normalize_city(F.col("n"))
    rows = df.select("n", key.alias("k"), X.normalize_city(key).alias("kk")).collect()
    assert {r["n"]: r["k"] for r in rows} == NAMES
    assert all(r["k"] == r["kk"] for r in rows)


def squares(spark, parts):
    """Rings ``(id, part, ring, [(x, y), ...])`` as edges."""
    rows = [(i, p, r, [[float(x), float(y)] for x, y in c]) for i, p, r, c in parts]
    return spatial.ring_edges(spark.createDataFrame(rows, "municipio_id long, part int, ring int, coords array<array<double>>"))


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def located(spark, edges, points):
    df = spark.createDataFrame([(i, float(la), float(lo)) for i, (la, lo) in enumerate(points)], "ponto_id int, lat double, lon double")
    return [r["municipio_id"] for r in spatial.locate_points(df, edges).orderBy("ponto_id").collect()]


def test_points_in_squares_holes_and_parts(spark):
    edges = squares(spark, [
        (1, 0, 0, box(-50, 0, -40, 10)), (1, 0, 1, box(-46, 4, -44, 6)), (1, 1, 0, box(-20, 0, -19.5, 0.5)),
        (2, 0, 0, box(-40, 0, -30, 10)), (3, 0, 0, box(-41, 8, -39, 9)),
    ])
    inside = [(5, -49), (5, -35), (8.5, -39.5), (8.5, -40.5), (0.25, -19.75)]
    assert located(spark, edges, inside) == [1, 2, 2, 1, 1]
    outside = [(5, -45), (5, -40), (0, -45), (10, -35), (4, -45), (4, -46), (0, -50), (11, -45), (8.5, -41)]
    assert located(spark, edges, outside) == [None] * 8 + [1]
    assert located(spark, edges, [(5, -49)] * 3) == [1] * 3
    assert tuple(spatial.locate_summary(spatial.locate_points(
        spark.createDataFrame([(5.0, -49.0), (99.0, 0.0)], "lat double, lon double"), edges)).head()) == (2, 1, 1)


def _inside(x, y, ring):
    """Plain ray test of a ring without points on its border."""
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_points_in_random_polygons(spark):
    import math

    rng = random.Random(3)
    rings = {}
    for i in range(6):
        cx, cy = rng.uniform(-60, -40), rng.uniform(-30, -5)
        rings[i] = [(cx + math.cos(a / 40 * math.tau) * rng.uniform(0.3, 4), cy + math.sin(a / 40 * math.tau) * rng.uniform(0.3, 4)) for a in range(40)]
    edges = squares(spark, [(i, 0, 0, c) for i, c in rings.items()])
    points = [(rng.uniform(-34, -1), rng.uniform(-64, -36)) for _ in range(300)]
    want = [min((i for i, c in rings.items() if _inside(lo, la, c)), default=None) for la, lo in points]
    assert located(spark, edges, points) == want and sum(w is not None for w in want) > 20


def test_representative_point_is_inside(spark):
    shapes = {
        1: [(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10)],
        2: [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)],
        3: [(0, 0), (5, 1), (0, 2), (1, 1)],
    }
    edges = squares(spark, [(i, 0, 0, c) for i, c in shapes.items()] + [(1, 1, 0, box(20, 0, 21, 1)), (4, 0, 0, box(0, 0, 9, 9)), (4, 0, 1, box(1, 1, 8, 8))])
    rows = {r["municipio_id"]: (r["lon"], r["lat"]) for r in spatial.representative_point(edges).collect()}
    assert set(rows) == {1, 2, 3, 4}
    for i, ring in shapes.items():
        assert _inside(*rows[i], ring)
    spot = spark.createDataFrame([rows[4]], "x double, y double")
    assert 4 in {r["municipio_id"] for r in spatial.points_in_polygons(spot, edges).collect()}


def test_map_cells_wraps_longitude(spark):
    edges = squares(spark, [(9, 0, 0, box(-50, 0, -40, 10))])
    cells = spark.createDataFrame([(0, 0, 5.0, 315.0), (0, 1, 5.0, -45.0), (1, 0, 5.0, 330.0)], "iy int, ix int, lat float, lon float")
    assert {(r["iy"], r["ix"], r["municipio_id"]) for r in spatial.map_cells(cells, edges).collect()} == {(0, 0, 9), (0, 1, 9)}


# --- names ------------------------------------------------------------------

CATALOG = [(4106902, "Curitiba", "PR"), (4205407, "Florianópolis", "SC"), (4314902, "Porto Alegre", "RS"), (3550308, "São Paulo", "SP"), (3106200, "Belo Horizonte", "MG"), (3552205, "Sorocaba", "SP")]


def catalog(spark, rows=CATALOG):
    df = spark.createDataFrame([(i, n, u, 1.0, 2.0) for i, n, u in rows], "id long, nome string, uf string, lat_centroide double, lon_centroide double")
    return df.withColumn("nome_normalizado", X.normalize_city(F.col("nome")))


def resolve(spark, pairs):
    df = spark.createDataFrame([(c, u) for c, u in pairs], "cidade string, uf string")
    return {(r["cidade"], r["uf"]): (r["municipio_id"], r["metodo"]) for r in G.geocode(df, catalog(spark)).collect()}


def test_geocode_methods(spark):
    out = resolve(spark, [("CURITIBA", "pr"), ("Curitba", "PR"), ("Floriano", "SC"), ("Xyzzyx Qwerty", "SC"), ("", "PR"), ("Paulo São", "SP"), ("Curitiba", "AC"), ("Curitiba", "SP")])
    assert out == {
        ("CURITIBA", "PR"): (4106902, "cache_exato"), ("Curitba", "PR"): (4106902, "cache_fuzzy"),
        ("Floriano", "SC"): (4205407, "cache_fuzzy"), ("Xyzzyx Qwerty", "SC"): (None, "nao_encontrado"),
        ("", "PR"): (None, "nao_encontrado"), ("Paulo São", "SP"): (3550308, "cache_fuzzy"),
        ("Curitiba", "AC"): (None, "uf_sem_catalogo"), ("Curitiba", "SP"): (None, "nao_encontrado"),
    }


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _score(a, b):
    def ratio(p, q):
        return 100.0 * (1.0 - float(2 * _lev(p, q) - abs(len(p) - len(q))) / float(len(p) + len(q)))

    stretch = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if stretch < 1.5:
        s, t = set(a.split()), set(b.split())
        best = max(best, 0.95 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 95.0 if s <= t or t <= s else 0.0)
    elif stretch <= 8 and (a in b or b in a):
        best = max(best, 90.0)
    return best


@pytest.mark.parametrize("cutoff", [70.0, 90.0, 96.0, 100.0])
def test_no_pair_above_the_cutoff_is_missed(spark, cutoff):
    rng = random.Random(int(cutoff))
    words = ["sao", "santa", "joao", "nova", "rio", "do", "campo", "alegre", "belo", "vista", "ipe", "ouro"]
    known = {" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)}
    asked = set()
    for name in sorted(known):
        for _ in range(3):
            letters = list(name)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice([[], ["z"], [letters[at], "k"]])
                letters = letters or ["q"]
            asked.add(" ".join("".join(letters).split()))
        asked.add(" ".join(rng.sample(words, 2)))
    asked.discard("")
    want = {(a, b) for a in asked for b in known if _score(a, b) >= cutoff}
    names = spark.createDataFrame([("AA", a) for a in sorted(asked)], "uf string, alvo string")
    dim = catalog(spark, [(i, n, "AA") for i, n in enumerate(sorted(known))])
    got = {(r["a"], r["b"]) for r in G.fuzzy_pairs(names, dim, cutoff).collect()}
    assert got == want and (cutoff < 100) <= bool(len(want) > len(known) / 2)


def test_long_junk_names_are_harmless_and_bad_cutoffs_refused(spark):
    names = spark.createDataFrame([("PR", "x" * 20_000), ("PR", "curitiba " + "y" * 5000)], "uf string, alvo string")
    assert G.fuzzy_pairs(names, catalog(spark)).count() == 0
    with pytest.raises(ValidationError):
        G.fuzzy_pairs(names, catalog(spark), 50.0)


def test_ties_go_to_the_first_name(spark):
    dim = catalog(spark, [(2, "abcdefghij x", "AA"), (1, "abcdefghij y", "AA")])
    names = spark.createDataFrame([("AA", "abcdefghij z")], "uf string, alvo string")
    assert G.geocode_fuzzy(names, dim).head()["m"]["id"] == 2


# --- suppliers --------------------------------------------------------------


def test_import_labels(spark):
    lines = [(2, " Ana ", "Curitiba", "pr"), (3, "Ana", "Curitiba", "PR"), (4, "", "", "x"), (5, "Bia", "\t", "PR"), (6, "Bia", "Lapa", "PRX"), (7, "Caio", "Lapa", "PR"), (8, None, "a", "PR")]
    batch = spark.createDataFrame(lines, "numero_linha long, nome string, cidade string, uf string")
    existing = spark.createDataFrame([("Caio", "Lapa", "PR")], "nome string, cidade string, uf string")
    rows, labelled = P.import_suppliers(batch, existing)
    out = {r["numero_linha"]: (r["status"], r["motivo"]) for r in labelled.collect()}
    assert out == {
        2: ("importado", None), 3: ("duplicado", None), 4: ("erro", "nome vazio"), 5: ("erro", "cidade vazia"),
        6: ("erro", "uf inválida (esperado 2 letras)"), 7: ("duplicado", None), 8: ("erro", "nome vazio"),
    }
    assert [(r["nome"], r["uf"]) for r in rows.collect()] == [("Ana", "PR")]
    assert tuple(U.import_summary(labelled).head()) == (7, 1, 2, 4)
    again = U.import_summary(U.label_lines(batch, existing.unionByName(rows.select("nome", "cidade", "uf"))))
    assert again.head()["importados"] == 0


def test_coverage_reasons_keep_every_input(spark):
    inputs = spark.createDataFrame([("1", "Curitiba", "PR"), ("1", "Curitiba", "PR"), ("2", "São Paulo", "SP"), ("3", "Nada", "PR")], "identificador string, cidade string, uf string")
    results = spark.createDataFrame([(4106902,), (None,)], "municipio_id long")
    out = P.coverage(inputs, catalog(spark), results)
    rows = sorted((r["identificador"], r["tem_cobertura"], r["motivo_nao_encontrado"]) for r in out.collect())
    assert rows == [("1", True, None), ("1", True, None), ("2", False, "sem_dados_climaticos"), ("3", False, "municipio_nao_geocodificado")]
    assert tuple(P.coverage_summary(out).head()) == (4, 2, 2)
    assert tuple(P.coverage_summary(P.coverage(inputs.limit(0), catalog(spark), results)).head()) == (0, 0, 0)


def test_overlapping_features_of_one_municipality(spark):
    def box(a, b):
        return [[a, a], [b, a], [b, b], [a, b]]

    rings = [(1, f, 0, 0, box(*c)) for f, c in (("a", (0.0, 2.0)), ("b", (1.0, 3.0)))]
    edges = spatial.ring_edges(spark.createDataFrame(rings, "municipio_id long, feature string, part int, ring int, coords array<array<double>>"))
    points = spark.createDataFrame([(x, x) for x in (0.5, 1.5, 2.5, 3.5)], "lat double, lon double")
    found = {r.lat: r.municipio_id for r in spatial.locate_points(points, edges).collect()}
    assert found == {0.5: 1, 1.5: 1, 2.5: 1, 3.5: None}
    assert spatial.representative_point(edges).count() == 1


def test_lines_of_two_files_share_numbers(spark):
    rows = [("Ana", "Lapa", "SP", 2), ("Bia", "Lapa", "SP", 2), ("Ana", "Lapa", "SP", 2), ("Ana", "Lapa", "SP", 5)]
    batch = spark.createDataFrame(rows, "nome string, cidade string, uf string, numero_linha long")
    none = spark.createDataFrame([], "nome string, cidade string, uf string")
    out = U.label_lines(batch, none).collect()
    assert sorted((r.nome, r.numero_linha, r.status) for r in out) == [
        ("Ana", 2, "duplicado"), ("Ana", 2, "importado"), ("Ana", 5, "duplicado"), ("Bia", 2, "importado")
    ]


@pytest.mark.parametrize("cutoff", [90.0, 100.0])
def test_names_of_any_length_and_the_highest_cutoff(spark, cutoff):
    long = "ab cd " * 40 + "e"
    known = spark.createDataFrame([(1, "SP", long), (2, "SP", "lapa"), (3, "SP", "lapas")], "id long, uf string, nome_normalizado string")
    known = known.selectExpr("*", "nome_normalizado AS nome", "0D AS lat_centroide", "0D AS lon_centroide")
    names = spark.createDataFrame([("SP", "lapa"), ("SP", long if cutoff == 100 else "lapaz")], "uf string, alvo string")
    out = {(r.a, r.b) for r in G.fuzzy_pairs(names, known, cutoff).collect() if len(r.a) < 9}
    assert ("lapa", "lapa") in out and (cutoff < 100 or out == {("lapa", "lapa")})
