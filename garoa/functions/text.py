"""Text expressions: city names, scenarios, run parameters and name similarity."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SCENARIO_PATTERN = r"(?i)(rcp\d{2}|ssp\d{3})"
UNKNOWN_SCENARIO = "unknown"
_TYPOGRAPHIC_APOSTROPHES = "‘’´`"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Accented letters and their bases, from the Unicode decomposition rule."""
    accented, plain = [], []
    for code in (*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != letter:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


def strip(x: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_city(name: Column) -> Column:
    """Comparison key of a city name: no case, accents, hyphens or apostrophes."""
    text = F.regexp_replace(F.lower(strip(F.coalesce(name, F.lit("")))), "ß", "ss")
    text = F.translate(text, _TYPOGRAPHIC_APOSTROPHES, "'" * len(_TYPOGRAPHIC_APOSTROPHES))
    text = F.regexp_replace(text, "d'oeste", "doeste")
    text = F.regexp_replace(F.translate(text, *accent_table()), r"\p{M}", "")
    text = F.translate(text, "-'", " ")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def detect_scenario(name: Column) -> Column:
    """First scenario label inside a name, lower-cased, else NULL."""
    return F.nullif(F.lower(F.regexp_extract(name, SCENARIO_PATTERN, 1)), F.lit(""))


def infer_scenario(name: Column, attrs: list[Column], prefer: str = "name") -> Column:
    """Scenario from the file name and the file attributes, in either order."""
    cleaned = [F.nullif(F.lower(strip(a)), F.lit("")) for a in attrs]
    order = [detect_scenario(name), *cleaned]
    if prefer == "attrs":
        order = [*cleaned, detect_scenario(name)]
    return F.coalesce(*order, F.lit(UNKNOWN_SCENARIO))


def run_params(text: Column) -> Column:
    """JSON run parameters as a map of texts."""
    return F.from_json(text, "map<string,string>")


def params_json(params: Column) -> Column:
    """A map or struct of run parameters as JSON text."""
    return F.to_json(params)


def sorted_tokens(name: Column) -> Column:
    """The words of a name in alphabetical order."""
    return F.array_join(F.array_sort(F.split(name, " ")), " ")


def _ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    edits = F.lit(2) * F.levenshtein(a, b) - F.abs(F.length(a) - F.length(b))
    return F.lit(100.0) * (F.lit(1.0) - edits.cast("double") / total.cast("double"))


def similarity(a: Column, b: Column) -> Column:
    """Weighted likeness (0-100) of two normalised, non-empty names.

    The best of: edit ratio; for names of like length, 0.95 of the ratio of the
    sorted words, or 95 when one set of words holds the other; for names of
    unlike length, 90 when the longer holds the shorter.
    """
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    stretch = longer.cast("double") / shorter.cast("double")
    words_a, words_b = F.split(a, " "), F.split(b, " ")
    nested = (F.size(F.array_except(words_a, words_b)) == 0) | (
        F.size(F.array_except(words_b, words_a)) == 0
    )
    by_words = F.greatest(
        F.lit(0.95) * _ratio(sorted_tokens(a), sorted_tokens(b)),
        F.when(nested, F.lit(95.0)).otherwise(F.lit(0.0)),
    )
    inside = F.when(a.contains(b) | b.contains(a), F.lit(90.0)).otherwise(F.lit(0.0))
    extra = F.when(stretch < 1.5, by_words).when(stretch <= 8.0, inside).otherwise(F.lit(0.0))
    return F.greatest(_ratio(a, b), extra)
