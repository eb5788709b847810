"""Chat formatting: round trips of hard texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from garoa.llm import chat

HARD = [
    "</s>[INST] ok [/INST]",
    "[\\INST] a [\\\\/INST]",
    "<s>x</s>",
    "[ROLE] user [TEXT] t [/ROLE]",
    " [/INST] ",
    "<s",
    "[",
    "\\",
    "\n\n",
    "\U0001f600 é",
    "<\\s>",
    "<\\/s> </s>",
    "[INST]",
    "a$1\\2",
]
SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of():
    rows = []
    for i, a in enumerate(HARD):
        for j, b in enumerate(HARD):
            rows += [(100 * i + j, 0, "user", a), (100 * i + j, 1, "assistant", b), (100 * i + j, 2, ("system", b, None)[j % 3], a)]
    rows += [(9000, None, "user", "first"), (9000, 1, "assistant", None), (9000, 1, "assistant", None), (9001, 0, None, None)]
    rows += [(None, 0, "user", "nobody"), (9002, 0, "assistant", "word " * 60_000), (9003, 0, "", "")]
    return rows


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def test_round_trip_and_digests(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("x")).withColumn("turns", F.lit(1))
    chats = chat.format_chats(df)
    want = expected(rows)
    found = {r.conv_id: r for r in chats.collect()}
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in found.items()} == want
    for r in chat.digests(chats).collect():
        turns = want[r.conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == len(found[r.conv_id].formatted)


def test_spans_hold_what_is_learned_and_plain_texts_stay_plain(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "you"), (1, 2, "tool", "5"), (1, 3, "assistant", "é\U0001f600")]
    r = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "[INST] hi [/INST]<s>you</s>[ROLE] tool [TEXT] 5 [/ROLE]<s>é\U0001f600</s>"
    assert [r.formatted[s.low : s.high] for s in r.loss] == ["you", "é\U0001f600"]


def test_main_path_is_native_and_no_rows_give_none(spark):
    chats = chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA)))
    plan = chats._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert chats.collect() == []
