"""Jobs on places: municipality dimension, coverage of suppliers, supplier import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garoa.operators import geocode as G
from garoa.operators import municipalities as M
from garoa.operators import spatial
from garoa.operators import suppliers as S
from garoa.operators.results import municipalities_with_results
from garoa.operators.sizing import broadcast_if_small, keep
from garoa.schemas import MUNICIPALITY, SUPPLIER_SITE

# Why an input has no coverage.
NOT_GEOCODED = "municipio_nao_geocodificado"
NO_DATA = "sem_dados_climaticos"


def build_municipality_dim(base: DataFrame, catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Catalogue plus interior points, upserted into the dimension.

    A municipality without a polygon keeps NULL coordinates.
    """
    points = spatial.representative_point(edges).select(
        F.col("municipio_id").alias("id"),
        F.col("lat").alias("lat_centroide"),
        F.col("lon").alias("lon_centroide"),
    )
    rows = M.with_normalized_name(catalog).join(points, "id", "left")
    rows = rows.withColumn("atualizado_em", F.current_timestamp())
    shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MUNICIPALITY])
    return M.upsert_municipalities(base.select(*shaped.columns), shaped)


def coverage_join(items: DataFrame, with_data: DataFrame) -> DataFrame:
    """Flag geocoded inputs by whether their municipality has results, and say why not."""
    held = with_data.select("municipio_id", F.lit(True).alias("_held"))
    covered = F.coalesce(F.col("_held"), F.lit(False))
    reason = F.when(F.col("municipio_id").isNull(), F.lit(NOT_GEOCODED)).when(
        ~covered, F.lit(NO_DATA)
    )
    return items.join(held, "municipio_id", "left").select(
        "identificador",
        F.col("cidade").alias("cidade_entrada"),
        "uf_entrada",
        covered.alias("tem_cobertura"),
        "municipio_id",
        "nome_canonico",
        reason.alias("motivo_nao_encontrado"),
    )


def coverage(
    inputs: DataFrame,
    municipalities: DataFrame,
    results: DataFrame,
    cutoff: float = G.DEFAULT_CUTOFF,
) -> DataFrame:
    """Coverage of ``identificador, cidade, uf`` inputs, one row per input."""
    asked_as = inputs.select("identificador", "cidade", "uf", F.col("uf").alias("uf_entrada"))
    items = keep(G.geocode(asked_as, municipalities, cutoff))
    asked = items.select("municipio_id").filter(F.col("municipio_id").isNotNull())
    held = broadcast_if_small(municipalities_with_results(asked, results))
    return coverage_join(items, held)


def coverage_summary(items: DataFrame) -> DataFrame:
    """Totals of a coverage batch."""
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("tem_cobertura").alias("com_cobertura"),
        F.count_if(~F.col("tem_cobertura")).alias("sem_cobertura"),
    )


def import_suppliers(batch: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new supplier rows, labelled lines). Ids follow from the key."""
    labelled = S.label_lines(batch, existing)
    key = F.concat_ws("|", *S.SUPPLIER_KEY)
    now = F.current_timestamp()
    fresh = labelled.filter(F.col("status") == "importado").select(
        F.concat(F.lit("forn_"), F.substring(F.md5(key), 1, 26)).alias("id"),
        *S.SUPPLIER_KEY,
        now.alias("criado_em"),
        now.alias("atualizado_em"),
    )
    for name in ("lat", "lon", "municipio_id"):
        fresh = fresh.withColumn(name, F.lit(None))
    rows = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SUPPLIER_SITE])
    return rows, labelled
