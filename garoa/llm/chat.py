"""Chat formatting by grammar round trip, with DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn := "[INST] " text " [/INST]"                      user
          | "<s>" text "</s>"                              assistant
          | "[ROLE] " role " [TEXT] " text " [/ROLE]"      any other role

A text is written as it is where the reparsed conversation equals its source.
Where it does not, texts that hold a control string are escaped until it does:
``[INST]`` becomes ``[\\INST]``, and one backslash more where there are some
already, so that reading takes exactly one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = r"(?:/?INST\]|/?ROLE\]|TEXT\]|/?s>)"
_PLAIN = rf"([\[<])(\\*{_CONTROL})"
_ESCAPED = rf"([\[<])\\(\\*{_CONTROL})"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|\[ROLE\] .*? \[TEXT\] .*? \[/ROLE\]"
USER, ASSISTANT = "user", "assistant"
#: Rounds of escaping after the plain one. One is enough: an escaped text holds no control string.
ROUNDS = 1


def escape(text: Column) -> Column:
    """The text with each control string in it marked by one more backslash."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _render(turns: Column, escaped: bool) -> Column:
    """All turns in the template, and their texts escaped where they hold control strings."""

    def one(turn: Column) -> Column:
        role, text = (escape(turn[c]) if escaped else turn[c] for c in ("role", "text"))
        return (
            F.when(turn.role == USER, F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(turn.role == ASSISTANT, F.concat(F.lit("<s>"), text, F.lit("</s>")))
            .otherwise(F.concat(F.lit("[ROLE] "), role, F.lit(" [TEXT] "), text, F.lit(" [/ROLE]")))
        )

    return F.transform(turns, one)


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read from formatted text; what the grammar does not cover is left out."""

    def one(piece: Column) -> Column:
        inner = lambda head, tail: F.substring(piece, F.lit(head + 1), F.char_length(piece) - head - tail)
        body = inner(7, 8)
        split = F.instr(body, " [TEXT] ")
        return (
            F.when(piece.startswith("[INST] "), F.struct(F.lit(USER).alias("role"), unescape(body).alias("text")))
            .when(piece.startswith("<s>"), F.struct(F.lit(ASSISTANT).alias("role"), unescape(inner(3, 4)).alias("text")))
            .otherwise(
                F.struct(
                    unescape(F.substring(body, F.lit(1), split - 1)).alias("role"),
                    unescape(F.substring(body, split + 8, F.char_length(body))).alias("text"),
                )
            )
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss`` for each conversation of ``rows(conv_id, turn, role, text, ...)``.

    Rows go by turn, null first, ties by role and text; repeated rows are turns
    of their own. A null role or text is empty. Rows without ``conv_id`` are one
    conversation. ``turns`` is read back from ``formatted`` and equals the
    source: a conversation for which no round reaches that is an error, not a
    row. ``loss`` holds the spans of ``formatted`` (first code point from 0, and
    the one after the last) under the loss mask, one per assistant text. Other
    columns are ignored; an empty table gives an empty result.
    """
    row = F.struct("turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    chats = chats.select("conv_id", F.transform("rows", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"))
    pieces = _render(F.col("source"), False)
    for _ in range(ROUNDS):
        chats = chats.withColumn("pieces", pieces).withColumn("formatted", F.array_join("pieces", ""))
        same = parse(F.col("formatted")) == F.col("source")
        pieces = F.when(same, F.col("pieces")).otherwise(_render(F.col("source"), True))
    chats = chats.withColumn("pieces", pieces).withColumn("formatted", F.array_join("pieces", ""))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    wrong = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    chats = chats.withColumn("turns", F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(wrong))
    sizes = F.transform("pieces", F.char_length)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<low:int,high:int>>").alias("spans"))
    lettered = F.arrays_zip(sizes.alias("size"), F.col("turns").alias("turn"))
    step = lambda s, x: F.struct(
        (s.at + x.size).alias("at"),
        F.when(
            x.turn.role == ASSISTANT,
            F.concat(s.spans, F.array(F.struct((s.at + 3).alias("low"), (s.at + x.size - 4).alias("high")))),
        ).otherwise(s.spans).alias("spans"),
    )
    return chats.select("conv_id", "formatted", "turns", F.aggregate(lettered, nothing, step, lambda s: s.spans).alias("loss"))


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as numbers and digests."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s.low + 1, s.high - s.low))), "")
    read = chats.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), learned.alias("learned"))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("whole").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
