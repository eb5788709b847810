"""City names to municipalities: exact key first, likeness after."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garoa.errors import ValidationError
from garoa.functions import text as X
from garoa.operators.sizing import broadcast_if_small, keep, spread

DEFAULT_CUTOFF = 90.0
LOWEST_CUTOFF = 67.0
INDEX_ROWS = 10_000
MAX_STRETCH = 8.0
MIN_STRETCH = 1.5

# How an input was resolved.
EXACT = "cache_exato"
FUZZY = "cache_fuzzy"
NOT_FOUND = "nao_encontrado"
NO_CATALOG = "uf_sem_catalogo"


def name_index(municipalities: DataFrame) -> DataFrame:
    """One municipality (the smallest id) per UF and normalised name."""
    pick = F.min(F.struct("id", "nome", "lat_centroide", "lon_centroide"))
    return (
        municipalities.filter(F.col("nome_normalizado") != "")
        .groupBy("uf", "nome_normalizado")
        .agg(pick.alias("m"))
    )


def _held(municipalities: DataFrame) -> DataFrame:
    """The name index, kept, and broadcast with all its pieces while names are few."""
    return broadcast_if_small(name_index(municipalities), INDEX_ROWS)


def geocode_exact(names: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Left join of distinct ``(uf, alvo)`` on UF and normalised name."""
    return _exact(names, name_index(municipalities))


def _exact(names: DataFrame, index: DataFrame) -> DataFrame:
    return names.join(index.withColumnRenamed("nome_normalizado", "alvo"), ["uf", "alvo"], "left")


def _segments(name: Column, per_letter: float) -> Column:
    """Cut a name into one more piece than the edits it may take."""
    size = F.length(name)
    pieces = F.floor(size * F.lit(per_letter) + F.lit(1e-9)).cast("int") + 1

    def piece(i: Column) -> Column:
        start = F.floor(i * size / pieces).cast("int")
        end = F.floor((i + 1) * size / pieces).cast("int")
        return F.struct(F.substr(name, start + 1, end - start).alias("gram"), start.alias("at"))

    return F.explode(F.transform(F.sequence(F.lit(0), pieces - 1), piece))


def _substrings(name: Column, shortest: Column, longest: Column) -> Column:
    """Every substring of the given lengths with its position (none if they cross)."""
    size = F.length(name)
    low, high = F.greatest(shortest, F.lit(1)), F.least(longest, size)
    lengths = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def of_length(n: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), size - n),
            lambda start: F.struct(F.substr(name, start + 1, n).alias("gram"), start.alias("at")),
        )

    return F.explode(F.flatten(F.transform(lengths, of_length)))


def _by_edits(asked: DataFrame, known: DataFrame, shape, cutoff: float) -> DataFrame:
    """Pairs whose edit ratio may reach the cutoff.

    Within ``k`` edits, one of ``k + 1`` pieces of the known name stands
    unchanged in the asked one, at most ``k`` places away; both places are keys.
    """
    loss = 1.0 - cutoff / 100.0
    if loss == 0:
        same = [df.select("uf", c, shape(F.col(c)).alias("same")) for df, c in ((asked, "a"), (known, "b"))]
        return same[0].join(same[1], ["uf", "same"]).select("uf", "a", "b")
    per_letter = 2.0 * loss / (1.0 - loss)
    longest = math.ceil(1.0 / per_letter) + 1
    slack = F.floor(F.length("b") * F.lit(per_letter) + F.lit(1e-9)).cast("int")
    placed = known.select("uf", "b", _segments(shape(F.col("b")), per_letter).alias("s"))
    pieces = placed.select(
        "uf", "b", F.col("s.gram").alias("gram"), F.explode(F.sequence(F.col("s.at") - slack, F.col("s.at") + slack)).alias("at")
    )
    grams = asked.select(
        "uf", "a", _substrings(shape(F.col("a")), F.lit(1), F.lit(longest)).alias("s")
    ).select("uf", "a", F.col("s.gram").alias("gram"), F.col("s.at").alias("at"))
    la, lb = F.length("a"), F.length("b")
    alike = F.abs(la - lb) <= (la + lb) * F.lit(loss) + F.lit(1e-9)
    return grams.join(pieces, ["uf", "gram", "at"]).filter(alike).select("uf", "a", "b")


def _longest_word(name: Column) -> Column:
    words = F.transform(F.split(name, " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.array_max(words)["w"]


def _by_words(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs where one set of words may hold the other: its longest word is shared."""

    def words(df: DataFrame, name: str) -> DataFrame:
        return df.select("uf", name, F.explode(F.array_distinct(F.split(name, " "))).alias("w"))

    def longest(df: DataFrame, name: str) -> DataFrame:
        return df.select("uf", name, _longest_word(F.col(name)).alias("w"))

    like = F.greatest(F.length("a"), F.length("b")) < F.least(F.length("a"), F.length("b")) * MIN_STRETCH
    held = words(asked, "a").join(longest(known, "b"), ["uf", "w"])
    holds = longest(asked, "a").join(words(known, "b"), ["uf", "w"])
    return held.unionByName(holds).filter(like).select("uf", "a", "b")


def _by_inclusion(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs where the longer name holds the shorter one."""

    def parts(df: DataFrame, longer: str, shorter: str) -> DataFrame:
        size = F.length(longer)
        inner = _substrings(
            F.col(longer),
            F.ceil(size / F.lit(MAX_STRETCH)).cast("int"),
            F.least(F.floor(size / F.lit(MIN_STRETCH)).cast("int"), F.col("limit")),
        )
        return df.select("uf", longer, inner.alias("s")).select(
            "uf", longer, F.col("s.gram").alias(shorter)
        )

    return parts(asked, "a", "b").join(known.select("uf", "b"), ["uf", "b"]).select(
        "uf", "a", "b"
    ).unionByName(
        parts(known, "b", "a").join(asked.select("uf", "a"), ["uf", "a"]).select("uf", "a", "b")
    )


def _check_cutoff(cutoff: float) -> None:
    if not LOWEST_CUTOFF <= cutoff <= 100.0:
        raise ValidationError(f"cutoff must be in [{LOWEST_CUTOFF}, 100], got {cutoff}")


def fuzzy_pairs(names: DataFrame, municipalities: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """Every ``(uf, a, b, score)`` of one UF with a score of at least ``cutoff``, in [67, 100].

    ``names`` has distinct ``uf, alvo``. Pairs come from equi-joins on shared
    pieces of the names that no pair above the cutoff can avoid sharing; all
    pairs of a UF are never formed, and none above the cutoff is lost.
    """
    _check_cutoff(cutoff)
    return _pairs(keep(spread(names)), _held(municipalities), cutoff)


def _pairs(names: DataFrame, index: DataFrame, cutoff: float) -> DataFrame:
    known = index.select("uf", F.col("nome_normalizado").alias("b"))
    limit = known.agg(F.max(F.length("b"))).scalar()
    known = known.withColumn("limit", F.length("b"))
    asked = (
        names.select("uf", F.col("alvo").alias("a"), limit.alias("limit"))
        .filter((F.col("a") != "") & (F.length("a") <= F.col("limit") * F.lit(MAX_STRETCH)))
    )
    pairs = _by_edits(asked, known, lambda c: c, cutoff)
    pairs = pairs.unionByName(_by_edits(asked, known, X.sorted_tokens, cutoff))
    pairs = pairs.unionByName(_by_words(asked, known))
    pairs = pairs.unionByName(_by_inclusion(asked, known))
    scored = pairs.distinct().withColumn("score", X.similarity(F.col("a"), F.col("b")))
    return scored.filter(F.col("score") >= F.lit(cutoff))


def geocode_fuzzy(names: DataFrame, municipalities: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """Best municipality of each distinct ``(uf, alvo)``; ties by name, then id."""
    _check_cutoff(cutoff)
    return _closest(keep(spread(names)), _held(municipalities), cutoff)


def _closest(names: DataFrame, index: DataFrame, cutoff: float) -> DataFrame:
    best = (
        _pairs(names, index, cutoff)
        .groupBy("uf", "a")
        .agg(F.min(F.struct((-F.col("score")).alias("worst"), F.col("b").alias("b"))).alias("s"))
        .select(
            "uf",
            F.col("a").alias("alvo"),
            F.col("s.b").alias("nome_normalizado"),
            (-F.col("s.worst")).alias("score"),
        )
    )
    return best.join(index, ["uf", "nome_normalizado"]).select(
        "uf", "alvo", "m", "score"
    )


def geocode(inputs: DataFrame, municipalities: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """Resolve ``cidade, uf`` of every input; other columns pass through.

    Each distinct name is resolved once, then joined back. The distinct names
    and the name index are kept: the likeness search reads both several times.
    While the resolved names are few, the inputs are joined where they are.
    """
    _check_cutoff(cutoff)
    index = _held(municipalities)
    keyed = inputs.withColumn("uf", F.upper("uf")).withColumn("alvo", X.normalize_city(F.col("cidade")))
    names = spread(keyed.select("uf", "alvo").filter(F.col("alvo") != "").distinct())
    exact = keep(_exact(names, index))
    found = exact.filter(F.col("m").isNotNull()).select("uf", "alvo", "m", F.lit(EXACT).alias("_how"))
    rest = exact.filter(F.col("m").isNull()).select("uf", "alvo")
    close = _closest(rest, index, cutoff).select("uf", "alvo", "m", F.lit(FUZZY).alias("_how"))
    ufs = municipalities.select("uf", F.lit(True).alias("_uf")).distinct()
    how = (
        F.when(F.col("_uf").isNull(), F.lit(NO_CATALOG))
        .when(F.col("_how").isNull(), F.lit(NOT_FOUND))
        .otherwise(F.col("_how"))
    )
    return (
        keyed.join(broadcast_if_small(found.unionByName(close)), ["uf", "alvo"], "left")
        .join(broadcast_if_small(ufs), "uf", "left")
        .select(
            *inputs.columns,
            F.col("m.id").alias("municipio_id"),
            F.col("m.nome").alias("nome_canonico"),
            F.col("m.lat_centroide").alias("lat"),
            F.col("m.lon_centroide").alias("lon"),
            how.alias("metodo"),
        )
    )


def geocode_summary(items: DataFrame) -> DataFrame:
    """Total, found and not found."""
    found = F.col("municipio_id").isNotNull()
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(found).alias("encontrados"),
        F.count_if(~found).alias("nao_encontrados"),
    )
