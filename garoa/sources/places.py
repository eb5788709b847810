"""Supplier files, city lists, municipality polygons and catalogue."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garoa.errors import ConfigurationError
from garoa.functions import text as X
from garoa.operators.spatial import ring_edges

# Accepted header names, in order of preference.
NAME_HEADERS = ("nome", "razao_social", "razao social", "empresa")
CITY_HEADERS = ("cidade", "municipio", "município")
UF_HEADERS = ("uf", "estado", "sigla_uf")
POLYGON_ID = ("CD_MUN", "cd_mun", "CD_GEOCMU", "GEOCODIGO", "codigo_municipio", "id")
POLYGON_UF = ("SIGLA_UF", "UF", "sigla")
POLYGON_NAME = ("NM_MUN", "NOME", "NM_MUNICIP")

SUPPLIER_LINES = "nome string, cidade string, uf string, numero_linha bigint"


def _pick_headers(columns: list[str]) -> dict[str, str]:
    """Column that holds each field; the first matching header from the left wins."""
    found: dict[str, str] = {}
    for column in columns:
        low = column.strip().lstrip("﻿").lower()
        for field, names in (("nome", NAME_HEADERS), ("cidade", CITY_HEADERS), ("uf", UF_HEADERS)):
            if field not in found and low in names:
                found[field] = column
                break
    return found


def number_lines(df: DataFrame, name: str, start: int) -> DataFrame:
    """Consecutive numbers in input order, from one count per partition."""
    place = F.monotonically_increasing_id()
    marked = df.withColumn("_at", place).withColumn("_part", F.shiftright("_at", 33))
    counts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # One row per input partition: small by construction.
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        marked.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + inside + F.lit(start))
        .drop("_at", "_part", "_before")
    )


def supplier_lines(df: DataFrame) -> DataFrame:
    """Any table with accepted headers as ``nome, cidade, uf, numero_linha``.

    Blank rows go; without all three headers the batch is empty. An own
    ``numero_linha`` is kept, else lines count from 2 (the header is line 1).
    """
    found = _pick_headers(df.columns)
    if set(found) != {"nome", "cidade", "uf"}:
        return df.sparkSession.createDataFrame([], SUPPLIER_LINES)
    numbered = df if "numero_linha" in df.columns else number_lines(df, "numero_linha", 2)
    filled = F.lit(False)
    for column in df.columns:
        if column != "numero_linha":
            filled = filled | (X.strip(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))) != "")

    def cell(field: str) -> Column:
        return F.coalesce(F.col(f"`{found[field]}`").cast("string"), F.lit("")).alias(field)

    return numbered.filter(filled).select(
        cell("nome"), cell("cidade"), cell("uf"), F.col("numero_linha").cast("bigint").alias("numero_linha")
    )


def _csv_patterns(sep: str) -> tuple[str, str, str, str]:
    """Body of a quoted field, what may follow its closing quote, a closed field, and one that may stay open.

    As ``csv.reader`` reads: a quote opens a field at its start only; elsewhere in
    an unquoted field, or after a closing quote, it is a plain character. Nothing
    backtracks.
    """
    cut = "\\x{%x}" % ord(sep)
    body = r'[^"]*+(?:""[^"]*+)*+'
    tail = rf'(?:[^"{cut}][^{cut}]*+)?+'
    return body, tail, rf'(?:"{body}"{tail}|{tail})', rf'(?:"{body}(?:"{tail})?+|{tail})'


def csv_records(lines: DataFrame, block: int = 1 << 16, sep: str = ",") -> DataFrame:
    """``numero_linha, record`` of the physical lines ``value`` of a CSV file, in order.

    A record ends at a line end outside a quoted field; every record counts, blank
    ones too. A line is a function of whether a quoted field is open before it: it
    keeps or turns that, or settles it. Turns are summed, and the last settled
    state and the records found, inside blocks of lines, then over blocks.
    """
    numbered = number_lines(lines, "_n", 0).withColumn("_block", F.floor(F.col("_n") / block))

    def before(df: DataFrame, amount: Column, name: str, of=F.sum) -> DataFrame:
        inside = Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
        over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy("_block").agg(of(amount).alias("_sum"))
        offset = sums.select("_block", F.coalesce(of("_sum").over(over), F.lit(0)).alias("_off"))
        own = F.coalesce(of(amount).over(inside), F.lit(0))
        both = F.col(name) + F.col("_off") if of is F.sum else F.greatest(name, "_off")
        return df.withColumn(name, own).join(offset, "_block").withColumn(name, both).drop("_off")

    body, tail, field, _ = _csv_patterns(sep)
    cut = "\\x{%x}" % ord(sep)
    last = rf'(?:{field}{cut})*+"{body}\z'
    closed, opened = F.col("value").rlike(rf"\A{last}"), F.col("value").rlike(rf'\A{body}(?:\z|"{tail}{cut}{last})')
    ends = numbered.withColumn("_from_closed", closed).withColumn("_from_open", opened)
    turned = before(ends.withColumn("_t", (F.col("_from_closed") & ~F.col("_from_open")).cast("bigint")), F.col("_t"), "_turns")
    # A settled state is kept next to its line, without the turns before it.
    settled = F.when(
        F.col("_from_closed") == F.col("_from_open"),
        2 * F.col("_n") + (F.col("_from_closed").cast("bigint") + F.col("_turns")) % 2,
    )
    known = before(turned.withColumn("_s", settled), F.col("_s"), "_settled", F.max)
    starts = ((F.col("_settled") + F.col("_turns")) % 2 == 0).cast("bigint")
    counted = before(known.withColumn("_start", starts), F.col("_start"), "_before")
    record = (F.col("_before") + F.col("_start")).alias("numero_linha")
    parts = counted.groupBy(record).agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("_lines"))
    return parts.select("numero_linha", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("record"))


def csv_cells(record: Column, sep: str) -> Column:
    """Fields of a record as ``csv.reader`` reads them."""
    body, tail, _, field = _csv_patterns(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf"\G\x{{{ord(sep):x}}}({field})"), F.lit(1))

    def plain(cell: Column) -> Column:
        inner = F.regexp_extract(cell, rf'\A"({body})', 1)
        rest = F.regexp_extract(cell, rf'\A"{body}"({tail})\z', 1)
        return F.when(cell.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(cell)

    return F.transform(raw, plain)


def read_suppliers_csv(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """Supplier lines of a CSV file with a header; a quoted field may span lines.

    Records are numbered from the header's 1, blank ones included.
    """
    raw = spark.read.text(path).select(F.decode(F.col("value").cast("binary"), encoding).alias("value"))
    records = csv_records(raw, sep=sep)
    head = records.filter(F.col("numero_linha") == 1).head(1)
    names = next(csv.reader([head[0].record], delimiter=sep), []) if head else []
    if not names:
        return spark.createDataFrame([], SUPPLIER_LINES)
    rows = records.filter("numero_linha > 1").select("numero_linha", csv_cells(F.col("record"), sep).alias("r"))
    unique = [n if n not in names[:i] else f"{n}#{i}" for i, n in enumerate(names)]
    return supplier_lines(rows.select("numero_linha", *[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(unique)]))


def parse_city_list(lines: DataFrame) -> DataFrame:
    """``CITY/UF`` lines (column ``value``), cut at the last ``/``; the line is the identifier."""
    line = X.strip(F.col("value"))
    pattern = r"(?s)^(.*)/([^/]*)$"
    parsed = lines.select(
        line.alias("identificador"),
        X.strip(F.regexp_extract(line, pattern, 1)).alias("cidade"),
        F.upper(X.strip(F.regexp_extract(line, pattern, 2))).alias("uf"),
    )
    return parsed.filter((F.col("cidade") != "") & (F.col("uf") != ""))


def parse_city_list_with_id(lines: DataFrame) -> DataFrame:
    """``ID;CITY/UF`` or ``CITY/UF`` lines; two-letter UF; missing ids become ``linha-N``.

    ``N`` counts the accepted lines by ``numero_linha``.
    """
    line = X.strip(F.col("value"))
    has_id = line.rlike(r"(?s)^[^;]*;.+$")
    code = X.strip(
        F.when(has_id, F.regexp_extract(line, r"(?s)^([^;]*);(.+)$", 1))
        .when(line.contains(";"), line)
        .otherwise(F.lit(""))
    )
    place = F.when(has_id, F.regexp_extract(line, r"(?s)^([^;]*);(.+)$", 2)).otherwise(line)
    halves = F.split(place, "/")
    parsed = lines.select(
        "numero_linha",
        code.alias("codigo"),
        X.strip(halves[0]).alias("cidade"),
        F.upper(X.strip(F.get(halves, F.lit(1)))).alias("uf"),
    ).filter((F.col("cidade") != "") & (F.length("uf") == 2))
    numbered = number_lines_by(parsed, "numero_linha", "_n")
    return numbered.select(
        "numero_linha",
        F.coalesce(F.nullif("codigo", F.lit("")), F.concat(F.lit("linha-"), F.col("_n"))).alias("identificador"),
        "cidade",
        "uf",
    )


def number_lines_by(df: DataFrame, order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Consecutive numbers from 1 by a line number, ranked inside blocks of lines.

    A block holds a bounded range of line numbers; earlier blocks add their
    counts, so no task ranks the whole list.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n_block"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_block", F.coalesce(F.sum("_n_block").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return (
        blocked.withColumn("_inside", inside)
        .join(offsets, "_block")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_inside", "_before")
    )


def read_city_list(spark: SparkSession, path: str) -> DataFrame:
    """City list of a text file."""
    return parse_city_list(spark.read.text(path))


def read_city_list_with_id(spark: SparkSession, path: str) -> DataFrame:
    """City list with optional ids of a text file."""
    return parse_city_list_with_id(number_lines(spark.read.text(path), "numero_linha", 1))


_POLYGON = "array<array<array<double>>>"


def _feature_struct() -> T.StructType:
    geometry = T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.StringType()),
            T.StructField(
                "geometries",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
                    )
                ),
            ),
        ]
    )
    return T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
            T.StructField("geometry", geometry),
            *geometry.fields[1:],
        ]
    )


def geojson_rings(features: DataFrame) -> DataFrame:
    """``municipio_id, uf, nome[, feature], part, ring, coords`` of features with ``properties, geometry[, feature]``."""
    own = ["feature"] if "feature" in features.columns else []
    simple = F.struct(
        F.col("geometry.type").alias("type"), F.col("geometry.coordinates").alias("coordinates")
    )
    shapes = F.when(F.col("geometry.geometries").isNotNull(), F.col("geometry.geometries")).otherwise(
        F.array(simple)
    )

    def property_of(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_element_at("properties", F.lit(n)) for n in names])

    flat = features.select(
        property_of(POLYGON_ID).alias("municipio_id"),
        property_of(POLYGON_UF).alias("uf"),
        property_of(POLYGON_NAME).alias("nome"),
        *own,
        F.posexplode(shapes).alias("shape", "g"),
    )
    polygons = F.when(
        F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", _POLYGON))
    ).when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{_POLYGON}>"))
    return (
        flat.select("municipio_id", "uf", "nome", *own, "shape", F.posexplode(polygons).alias("piece", "rings"))
        .select(
            "municipio_id",
            "uf",
            "nome",
            *own,
            (F.col("shape") * 100_000 + F.col("piece")).alias("part"),
            F.posexplode("rings").alias("ring", "coords"),
        )
    )


def read_municipality_polygons(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Edges of the municipality polygons of GeoJSON files (coordinates in degrees, WGS 84).

    A file holds a FeatureCollection, or, with ``multi_line=False``, one feature
    per line, which splits across tasks.
    """
    feature = _feature_struct()
    schema = T.StructType([*feature.fields, T.StructField("features", T.ArrayType(feature))])
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    single = F.struct(*[F.col(f.name) for f in feature.fields])
    many = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.array(single))
    place = F.concat_ws("-", F.col("_metadata.file_path"), F.monotonically_increasing_id().cast("string"))
    numbered = raw.select(place.alias("place"), F.posexplode(many).alias("n", "f"))
    features = numbered.select("f.properties", "f.geometry", F.concat_ws("-", "place", "n").alias("feature"))
    return ring_edges(require_id(geojson_rings(features)))


def require_id(rings: DataFrame) -> DataFrame:
    """Fail, when read, on a polygon without any of the accepted id properties."""
    missing = F.raise_error(F.lit(f"polygon without an id; accepted properties: {POLYGON_ID}"))
    return rings.withColumn("municipio_id", F.coalesce("municipio_id", missing.cast("string")))


def polygon_columns(columns: list[str]) -> dict[str, str]:
    """Id, UF and name columns of a flat polygon table."""
    wanted = (("id", POLYGON_ID), ("uf", POLYGON_UF), ("nome", POLYGON_NAME))
    found = {field: next((n for n in names if n in columns), None) for field, names in wanted}
    lost = [field for field, column in found.items() if column is None]
    if lost:
        raise ConfigurationError(f"no column for {lost} among {sorted(columns)}")
    return found


_CATALOG = (
    "id bigint, nome string, "
    "microrregiao struct<mesorregiao: struct<UF: struct<sigla: string>>>"
)


def flatten_catalog(raw: DataFrame, strict: bool = True) -> DataFrame:
    """``id, nome, uf`` of nested catalogue rows; a malformed row fails, or is dropped."""
    uf = F.col("microrregiao.mesorregiao.UF.sigla")
    rows = raw.select("id", "nome", uf.alias("uf"))
    broken = F.col("id").isNull() | F.col("nome").isNull() | F.col("uf").isNull()
    if not strict:
        return rows.filter(~broken)
    alarm = F.raise_error(F.lit("malformed municipality catalogue row")).cast("bigint")
    return rows.withColumn("id", F.when(broken, alarm).otherwise(F.col("id")))


def read_municipality_catalog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Municipality catalogue of JSON files."""
    return flatten_catalog(spark.read.schema(_CATALOG).option("multiLine", True).json(path), strict)
