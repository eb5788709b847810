"""The municipality dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garoa.functions import text as X
from garoa.operators.results import page
from garoa.params import Page


def upsert_municipalities(base: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by ``id``; the last of several new rows (``ordem``) wins."""
    columns = base.columns
    if "ordem" in new.columns:
        last = F.max_by(F.struct(*columns), "ordem")
    else:
        last = F.max(F.struct(*columns))
    latest = new.groupBy(F.col("id").alias("_id")).agg(last.alias("r")).select("r.*")
    return base.join(latest.select("id"), "id", "left_anti").select(*columns).unionByName(latest)


def filter_municipalities(
    municipalities: DataFrame, uf: str | None = None, nome_normalizado: str | None = None
) -> DataFrame:
    """Listing by UF, or exact lookup by normalised name and UF."""
    rows = municipalities
    if uf is not None:
        rows = rows.filter(F.col("uf") == uf)
    if nome_normalizado is not None:
        rows = rows.filter(F.col("nome_normalizado") == nome_normalizado)
    return rows


def page_municipalities(municipalities: DataFrame, p: Page, uf: str | None = None) -> DataFrame:
    """By normalised name; ids break ties."""
    return page(filter_municipalities(municipalities, uf), ["nome_normalizado", "id"], p)


def with_normalized_name(catalog: DataFrame) -> DataFrame:
    """Add the comparison key of the name."""
    return catalog.withColumn("nome_normalizado", X.normalize_city(F.col("nome")))


def catalog_summary(municipalities: DataFrame) -> DataFrame:
    """Total, with and without a known point."""
    known = F.col("lat_centroide").isNotNull() & F.col("lon_centroide").isNotNull()
    return municipalities.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(known).alias("com_centroide"),
        F.count_if(~known).alias("sem_centroide"),
    )
