"""Exact percentiles of groups of any size, by sketches that bracket each rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garoa.operators.sizing import broadcast_if_small, detached

#: Accuracy of a sketch: 2048 puts a rank within about a quarter of a hundredth of the values.
SKETCH = 2048
#: Equal steps of rank that a sketch is read at.
STEPS = 256
#: Groups of fewer values are sorted whole; brackets of more are sketched again before anything is sorted.
FEW, MOST = 4096, 4_000_000
#: Sketches made inside a bracket, at most; each divides what is sorted by about eighty.
PASSES = 4
#: Steps around a rank that are tried for its bounds, one after the other; after them the bounds that counts have proved.
MARGINS = (1, 16)
_FACTS = ("below", "inside", "low", "high", "lo", "hi", "rank")


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"_{n}" for n in names})


def _same(names: list[str]) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return same


def _ladder(values: Column) -> Column:
    """Values at equal steps of rank; NULL of nothing. NaN is above all numbers and in no sketch."""
    sketch = F.kll_sketch_agg_double(values.cast("double"), F.lit(SKETCH))
    steps = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    read = F.kll_sketch_get_quantile_double(sketch, steps)
    return F.when(F.count(F.when(~F.isnan(values.cast("double")), values)) > 0, read)


def _bounds(margin: int) -> list[Column]:
    """Values that probably enclose the ranks: steps of the ladder at least ``margin`` away from them."""

    def at(step: Column) -> Column:
        return F.when((step >= 1) & (step <= STEPS - 1), F.element_at("ladder", step.cast("int") + 1))

    def step_of(rank: str) -> Column:
        return (F.col(rank) - F.col("below")) * STEPS / F.greatest(F.col("inside"), F.lit(1))

    many = F.col("inside") >= FEW
    low = F.when(many, at(F.floor(step_of("lo")) - margin))
    high = F.when(many, at(F.ceil(step_of("hi")) + margin))
    return [F.coalesce(low, F.col("low")).alias(f"low{margin}"), F.coalesce(high, F.col("high")).alias(f"high{margin}")]


def _state(groups: DataFrame, dims: list[str]) -> DataFrame:
    """Groups with their ranks, known bounds, and likely bounds of each margin, detached from what they were made of."""
    return detached(groups.select(*dims, *_FACTS, *[b for m in MARGINS for b in _bounds(m)]))


def _with_bounds(rows: DataFrame, state: DataFrame, dims: list[str], margin: int | None) -> DataFrame:
    """Values up to the upper bound of their group, the group's facts, and whether the lower one lets them in."""
    low, high = ("low", "high") if margin is None else (f"low{margin}", f"high{margin}")
    bounds = state.select(*dims, F.col(low).alias("l"), F.col(high).alias("h"), "lo", "hi", "rank")
    if dims:
        joined = rows.join(_renamed(broadcast_if_small(bounds), dims), _same(dims))
    else:
        [one] = bounds.head(1)
        joined = rows.select("*", *[F.lit(one[c]).cast(bounds.schema[c].dataType).alias(c) for c in bounds.columns])
    number = F.col("v").cast("double")
    inside = F.col("l").isNull() | (number >= F.col("l"))
    joined = joined.filter(F.col("v").isNotNull() & (F.col("h").isNull() | (number <= F.col("h"))))
    return joined.select(*dims, "v", inside.alias("in"), "l", "h", "lo", "hi", "rank")


def _without(state: DataFrame, other: DataFrame, dims: list[str]) -> DataFrame:
    """Groups of ``state`` that ``other`` does not have."""
    if not dims:
        return state if other.isEmpty() else state.limit(0)
    return state.join(_renamed(other.select(*dims), dims), _same(dims), "left_anti")


def _narrowed(rows: DataFrame, state: DataFrame, dims: list[str]) -> DataFrame:
    """Brackets with exact counts and a sketch of what is inside; a bracket that misses its ranks stays as it was."""
    counted = _with_bounds(rows, state, dims, MARGINS[0]).groupBy(*dims).agg(
        F.count_if(~F.col("in")).alias("below"),
        F.count_if("in").alias("inside"),
        _ladder(F.when(F.col("in"), F.col("v"))).alias("ladder"),
        *[F.max(c).alias(name) for c, name in (("l", "low"), ("h", "high"), ("lo", "lo"), ("hi", "hi"), ("rank", "rank"))],
    )
    good = counted.filter((F.col("below") <= F.col("lo")) & (F.col("hi") < F.col("below") + F.col("inside")))
    good = _state(good, dims)
    return good.unionByName(_without(state, good, dims))


def _exact(rows: DataFrame, state: DataFrame, dims: list[str], margin: int | None) -> DataFrame:
    """Values at the ranks, counted and sorted inside the bounds; NULL where the bounds do not hold the rank.

    All values below the bounds are one row of a group before they move.
    """
    inside = F.when(F.col("in"), F.col("v")).alias("v")
    placed = _with_bounds(rows, state, dims, margin).select(*dims, "lo", "hi", "rank", inside)
    counts = placed.groupBy(*dims, "lo", "hi", "rank", "v").agg(F.count(F.lit(1)).alias("c"))
    within = Window.partitionBy(*dims).orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranged = counts.withColumn("last", F.sum("c").over(within) - 1).withColumn("first", F.col("last") - F.col("c") + 1)

    def at(rank_name: str) -> Column:
        return F.max(F.when(F.col(rank_name).between(F.col("first"), F.col("last")), F.col("v")))

    found = ranged.groupBy(*dims).agg(
        at("lo").alias("_lo"), at("hi").alias("_hi"), F.max(F.col("rank") - F.col("lo")).alias("_f")
    )
    return detached(found)


def group_percentile(df: DataFrame, value: str, dims: list[str], q: float) -> DataFrame:
    """Linear-interpolated percentile per group: ``*dims, valor, n_amostras``.

    A group is never gathered. One pass sketches the values of each group, with
    partial sketches merged after the shuffle; the sketch names bounds that
    enclose the wanted ranks, and a second pass counts what is below them and sorts only
    what is inside, about a hundredth of a group. Counts decide, not sketches:
    groups whose bounds miss a rank are done again with wider ones, and brackets
    that still hold many values are sketched again first. ``df`` is read once per
    pass, by jobs that run while the plan is built; keep it before if it is costly.
    NULL is a group of its own; a group without values has NULL and 0.
    """
    keys = [F.col(d) for d in dims]
    rows = df.select(*keys, F.col(value).alias("v"))
    rank = F.lit(q) * (F.col("n_amostras") - 1)
    none = F.lit(None).cast("double")
    sums = rows.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("_rows"), F.count("v").alias("n_amostras"), _ladder(F.col("v")).alias("ladder")
    )
    sums = sums.select(
        *dims, "_rows", "n_amostras", "ladder", F.lit(0).cast("bigint").alias("below"), F.col("n_amostras").alias("inside"),
        none.alias("low"), none.alias("high"), F.floor(rank).alias("lo"), F.ceil(rank).alias("hi"), rank.alias("rank"),
    )
    sums = detached(sums.select(*dims, "_rows", "n_amostras", *_FACTS, *[b for m in MARGINS for b in _bounds(m)]))
    state = sums.filter("n_amostras > 0").drop("_rows", "n_amostras")
    for _ in range(PASSES):
        open_ = ~F.col(f"low{MARGINS[0]}").eqNullSafe(F.col(f"high{MARGINS[0]}"))
        if state.filter((F.col("inside") * 3 > F.lit(MOST) * STEPS) & open_).isEmpty():
            break
        state = _narrowed(rows, state, dims)
    parts = []
    for margin in (*MARGINS, None):
        if not state.isEmpty():
            found = _exact(rows, state, dims, margin)
            parts.append(found.filter("_lo is not null and _hi is not null"))
            state = _without(state, parts[-1], dims)
    # Both sides have a row per group; grouping their union treats NULL keys as
    # equal and also serves the case of a single group without keys.
    unknown = F.lit(None).cast(rows.schema["v"].dataType)
    merged = sums.select(*dims, "_rows", "n_amostras", unknown.alias("_lo"), unknown.alias("_hi"), none.alias("_f"))
    for part in parts:
        merged = merged.unionByName(part, allowMissingColumns=True)
    merged = merged.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_rows", "n_amostras", "_lo", "_hi", "_f")])
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    valor = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between)
    return merged.filter(F.col("_rows") > 0).select(*keys, valor.alias("valor"), "n_amostras")
