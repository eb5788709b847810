"""Small tables with odd rows."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra: str = ""):
    """Documents from ``(doc_id, text[, lang[, source]])``; ``extra`` adds columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in extra.split():
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed: int, n: int) -> list[str]:
    """Words of an invented text."""
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n)]


def odd_texts() -> list:
    """Null, empty, blank, tiny, repeated and long texts."""
    return [None, "", " \t\n", "one", "one", "a b c d", "Ä é 漢字 \U0001f600", "x" * 5000, " ".join(prose(1, 3000)), "la " * 500]
