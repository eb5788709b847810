"""Filters, joins, aggregations and pages over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garoa.functions import numeric as N
from garoa.operators.quantile import group_percentile
from garoa.operators.sizing import broadcast_if_small, detached, keep
from garoa.params import Aggregation, Page, ResultFilter, StressFilter

RESULT_ORDER = ["execucao_id", "ano", "nome_indice", "id"]
STRESS_ORDER = ["execucao_id", "ano", "municipio_id", "id"]
RUN_DIMENSIONS = ("cenario", "variavel")
_PERCENTILES = {"p50": 0.5, "p95": 0.95}


def all_of(conditions: list[Column]) -> Column:
    """AND of conditions; true when there is none."""
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def join_run(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Add scenario and variable of the run; results of unknown runs go."""
    dim = runs.select(F.col("id").alias("execucao_id"), "cenario", "variavel")
    return results.join(broadcast_if_small(dim), "execucao_id")


def join_municipality(results: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Add name and UF; results without a known municipality go."""
    dim = municipalities.select(
        F.col("id").alias("municipio_id"), F.col("nome").alias("nome_municipio"), "uf"
    )
    return results.join(broadcast_if_small(dim), "municipio_id")


def of_uf(rows: DataFrame, municipalities: DataFrame, uf: str) -> DataFrame:
    """Rows whose municipality belongs to a UF."""
    dim = municipalities.filter(F.col("uf") == uf).select(F.col("id").alias("municipio_id"))
    return rows.join(dim, "municipio_id", "left_semi")


def _year_conditions(f: ResultFilter | StressFilter) -> list[Column]:
    ano, out = F.col("ano"), []
    if f.ano is not None:
        out.append(ano == f.ano)
    if f.ano_min is not None:
        out.append(ano >= f.ano_min)
    if f.ano_max is not None:
        out.append(ano <= f.ano_max)
    return out


def result_conditions(f: ResultFilter) -> list[Column]:
    """The conditions that read the result table alone (they reach the scan)."""
    out = _year_conditions(f)
    if f.execucao_id is not None:
        out.append(F.col("execucao_id") == f.execucao_id)
    if f.nomes_indices:
        out.append(F.col("nome_indice").isin(*f.nomes_indices))
    if f.municipio_id is not None:
        out.append(F.col("municipio_id") == f.municipio_id)
    if f.radius is not None:
        out.append(N.in_radius(F.col("lat"), F.col("lon"), f.radius))
    elif f.bbox is not None:
        out.append(N.in_bbox(F.col("lat"), F.col("lon"), f.bbox))
    return out


def filter_results(
    results: DataFrame,
    f: ResultFilter,
    runs: DataFrame | None = None,
    municipalities: DataFrame | None = None,
    with_run: bool = False,
) -> DataFrame:
    """Apply every given condition; a dimension is joined only when one needs it.

    ``with_run`` keeps the run's scenario and variable, joined once even when
    they are also filtered on.
    """
    rows = results.filter(all_of(result_conditions(f)))
    if with_run or f.cenario is not None or f.variavel is not None:
        dim = runs
        if f.cenario is not None:
            dim = dim.filter(F.col("cenario") == f.cenario)
        if f.variavel is not None:
            dim = dim.filter(F.col("variavel") == f.variavel)
        rows = join_run(rows, dim)
        if not with_run:
            rows = rows.select(*results.columns)
    if f.uf is not None:
        rows = of_uf(rows, municipalities, f.uf)
    return rows


def aggregate_results(
    results: DataFrame,
    agg: Aggregation,
    f: ResultFilter = ResultFilter(),
    runs: DataFrame | None = None,
    municipalities: DataFrame | None = None,
) -> DataFrame:
    """``*dimensions, valor, n_amostras`` over the filtered results.

    NULL values are skipped except by ``count``. Without dimensions there is one
    global row, also on empty input, but none for a percentile or inside a radius.
    """
    needs_run = any(d in RUN_DIMENSIONS for d in agg.dimensoes)
    rows = filter_results(results, f, runs, municipalities, with_run=needs_run)
    rows = rows.withColumn("municipio", F.col("municipio_id"))
    dims = list(agg.dimensoes)
    if agg.funcao in _PERCENTILES:
        return group_percentile(rows.select(*dims, "valor"), "valor", dims, _PERCENTILES[agg.funcao])
    valor = F.col("valor")
    every = F.count(F.lit(1))
    chosen = {
        "media": F.avg(valor),
        "min": F.min(valor),
        "max": F.max(valor),
        "count": every.cast("double"),
    }[agg.funcao]
    n = every if agg.funcao == "count" else F.count(valor)
    out = rows.groupBy(*dims).agg(
        chosen.alias("valor"), n.alias("n_amostras"), every.alias("_rows")
    )
    if f.radius is not None:
        out = out.filter(F.col("_rows") > 0)
    return out.drop("_rows")


def ordered(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Global order; NULL first on ascending keys."""
    return df.orderBy(*keys)


def numbered(df: DataFrame, name: str = "n") -> DataFrame:
    """Rows with their number, from 1, in the order that the frame has.

    A row's number is its place in its partition and the rows of the partitions
    before, so that only one row per partition meets in a task.
    """
    placed = detached(df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    rows = placed.withColumn("_place", place).join(before, "_part")
    return rows.select(*df.columns, (F.col("_before") + F.col("_place")).cast("int").alias(name))


def page(df: DataFrame, order: list[Column | str], p: Page) -> DataFrame:
    """One page of an ordered listing (planned as a top-k, not as a full sort)."""
    return df.orderBy(*order).offset(p.offset).limit(p.limit)


def count_rows(df: DataFrame, name: str = "total") -> DataFrame:
    """Row count as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def distinct_values(results: DataFrame, dim: str, runs: DataFrame | None = None) -> DataFrame:
    """Sorted distinct values of a dimension, of runs that have results."""
    column = "municipio_id" if dim == "municipio" else dim
    if dim in RUN_DIMENSIONS:
        held = results.select(F.col("execucao_id").alias("id")).distinct()
        rows = runs.join(held, "id", "left_semi")
    else:
        rows = results
    return (
        rows.select(F.col(column).alias(dim)).filter(F.col(dim).isNotNull()).distinct().orderBy(dim)
    )


def result_counters(results: DataFrame) -> DataFrame:
    """Runs that have results, and rows."""
    return results.agg(
        F.countDistinct("execucao_id").alias("total_execucoes_com_resultados"),
        F.count(F.lit(1)).alias("total_resultados"),
    )


def stats_summary(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct vocabularies and counters in one row.

    The results are read once, into the few combinations of run, year and index.
    """
    held = keep(
        results.groupBy("execucao_id", "ano", "nome_indice").agg(F.count(F.lit(1)).alias("n"))
    )

    def listed(dim: str) -> Column:
        values = distinct_values(held, dim, runs)
        return values.agg(F.sort_array(F.collect_list(dim))).scalar()

    return held.agg(
        F.countDistinct("execucao_id").alias("total_execucoes_com_resultados"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_resultados"),
    ).select(
        listed("cenario").alias("cenarios"),
        listed("ano").alias("anos"),
        listed("variavel").alias("variaveis"),
        listed("nome_indice").alias("nomes_indices"),
        "total_execucoes_com_resultados",
        "total_resultados",
    )


def entity_counters(suppliers: DataFrame, municipalities: DataFrame, runs: DataFrame) -> DataFrame:
    """Sizes of the three entity tables in one row."""
    every = F.count(F.lit(1))
    return suppliers.agg(every.alias("fornecedores")).select(
        "fornecedores",
        municipalities.agg(every).scalar().alias("municipios"),
        runs.agg(every).scalar().alias("execucoes"),
    )


def municipalities_with_results(ids: DataFrame, results: DataFrame) -> DataFrame:
    """Those of ``ids`` that appear in some result; NULL never does."""
    held = results.select("municipio_id").filter(F.col("municipio_id").isNotNull()).distinct()
    return ids.select("municipio_id").distinct().join(held, "municipio_id", "left_semi")


# --- water-stress results ---------------------------------------------------


def stress_with_municipality(stress: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Add name and UF; both NULL for an unknown municipality."""
    dim = municipalities.select(
        F.col("id").alias("municipio_id"), F.col("nome").alias("nome_municipio"), "uf"
    )
    return stress.join(dim, "municipio_id", "left")


def filter_stress(
    stress: DataFrame, f: StressFilter, municipalities: DataFrame | None = None
) -> DataFrame:
    """Run, scenario, years, municipality and UF."""
    conditions = _year_conditions(f)
    if f.execucao_id is not None:
        conditions.append(F.col("execucao_id") == f.execucao_id)
    if f.cenario is not None:
        conditions.append(F.col("cenario") == f.cenario)
    if f.municipio_id is not None:
        conditions.append(F.col("municipio_id") == f.municipio_id)
    rows = stress.filter(all_of(conditions))
    return rows if f.uf is None else of_uf(rows, municipalities, f.uf)


def yearly_mean_frequency(stress: DataFrame) -> DataFrame:
    """Mean number of dry-hot days per year, ascending."""
    return (
        stress.groupBy("ano")
        .agg(F.avg("frequencia_dias_secos_quentes").alias("frequencia_media"))
        .orderBy("ano")
    )


# --- runs -------------------------------------------------------------------


def filter_runs(
    runs: DataFrame,
    cenario: str | None = None,
    variavel: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Exact equality on the given fields."""
    given = {"cenario": cenario, "variavel": variavel, "status": status}
    return runs.filter(all_of([F.col(k) == v for k, v in given.items() if v is not None]))


def page_runs(runs: DataFrame, p: Page) -> DataFrame:
    """Newest first; ids break ties."""
    return page(runs, [F.col("criado_em").desc(), F.col("id")], p)
