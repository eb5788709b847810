"""Supplier import and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garoa.functions import text as X
from garoa.operators.results import all_of, page
from garoa.params import Page

SUPPLIER_KEY = ["nome", "cidade", "uf"]

# The reasons a line is refused, tested in this order.
NO_NAME = "nome vazio"
NO_CITY = "cidade vazia"
BAD_UF = "uf inválida (esperado 2 letras)"


def clean_supplier(lines: DataFrame) -> DataFrame:
    """Trim the three fields; UF in upper case; a missing field is empty."""

    def field(name: str) -> Column:
        return X.strip(F.coalesce(F.col(name), F.lit("")))

    return lines.withColumns(
        {"nome": field("nome"), "cidade": field("cidade"), "uf": F.upper(field("uf"))}
    )


def refusal(lines: DataFrame) -> DataFrame:
    """Add ``motivo``, NULL for a valid line."""
    reason = (
        F.when(F.col("nome") == "", F.lit(NO_NAME))
        .when(F.col("cidade") == "", F.lit(NO_CITY))
        .when(F.length("uf") != 2, F.lit(BAD_UF))
    )
    return lines.withColumn("motivo", reason)


def first_lines(valid: DataFrame) -> DataFrame:
    """First line of every ``(nome, cidade, uf)``, found before the shuffle."""
    return valid.groupBy(*SUPPLIER_KEY).agg(F.min("numero_linha").alias("numero_linha"))


def new_suppliers(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose key is not in the supplier table yet."""
    return batch.join(existing.select(*SUPPLIER_KEY), SUPPLIER_KEY, "left_anti")


def label_lines(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Status of every line: ``importado``, ``duplicado`` or ``erro`` with a reason.

    Lines of several files may share a number; equal lines are counted and dealt
    out again, the first as the one to import. The winners are joined back on
    number and key, so a key repeated on a third of the lines does not gather in
    one task.
    """
    line = ["numero_linha", *SUPPLIER_KEY]
    counted = refusal(clean_supplier(batch)).groupBy(*line, "motivo").agg(F.count(F.lit(1)).alias("_n"))
    checked = counted.select(*line, "motivo", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_copy"))
    winners = new_suppliers(first_lines(checked.filter(F.col("motivo").isNull())), existing)
    marks = winners.select(*line, F.lit(True).alias("_new"))
    status = (
        F.when(F.col("motivo").isNotNull(), F.lit("erro"))
        .when(F.col("_new") & (F.col("_copy") == 1), F.lit("importado"))
        .otherwise(F.lit("duplicado"))
    )
    return (
        checked.join(marks, line, "left")
        .withColumn("status", status)
        .select("numero_linha", *SUPPLIER_KEY, "status", "motivo")
    )


def import_summary(labelled: DataFrame) -> DataFrame:
    """Totals of an import."""

    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return labelled.agg(
        F.count(F.lit(1)).alias("total_linhas"),
        of("importado").alias("importados"),
        of("duplicado").alias("duplicados"),
        of("erro").alias("erros"),
    )


def filter_suppliers(
    suppliers: DataFrame, uf: str | None = None, cidade: str | None = None
) -> DataFrame:
    """Exact equality; the UF is compared in upper case."""
    conditions = []
    if uf is not None:
        conditions.append(F.col("uf") == uf.upper())
    if cidade is not None:
        conditions.append(F.col("cidade") == cidade)
    return suppliers.filter(all_of(conditions))


def page_suppliers(suppliers: DataFrame, p: Page) -> DataFrame:
    """Newest first; ids break ties."""
    return page(suppliers, [F.col("criado_em").desc(), F.col("id")], p)
