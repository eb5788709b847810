"""Toxicity: held-out quality, counts against a plain reading, what teaches, and odd rows."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import docs, odd_texts, prose
from pyspark.sql import functions as F

from garoa.llm import toxicity
from garoa.llm.shared import table

LABELS = "doc_id long, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def invented(n=400, seed=5):
    """Texts of which a third hold invented insults at random places."""
    draw, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words, bad = prose(i, 60), i % 3 == 0
        for _ in range(4 if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["zugrimm", "zugrand", "plorten", "vashtuk"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def answers(spark):
    rows, labels = invented()
    odd = [(1000 + i, t) for i, t in enumerate(odd_texts())] + [(None, rows[0][1]), (0, rows[0][1]), (2001, " ".join(prose(1, 400_000)))]
    extra = [(3, None), (None, 1), (1001, 1), (99_999, 1), (0, 1), (6, 7)]
    df = docs(spark, rows + odd, "score toxic fold hash predicted")
    out = toxicity.toxicity(df, spark.createDataFrame(labels + extra, LABELS).selectExpr("*", "'x' AS text", "0.5 AS score")).collect()
    return rows + odd, dict(labels), out


def test_held_out_texts_are_told_apart(answers):
    rows, labels, out = answers
    assert len(out) == len(rows)
    of = {r.doc_id: r for r in out}
    judged = [of[i] for i in labels if held(i)]
    assert all(r.held_out for r in judged) and len(judged) > 50
    assert sum(r.predicted == labels[r.doc_id] for r in judged) >= 0.97 * len(judged)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_odd_texts_are_scored_and_equal_texts_alike(answers):
    rows, _, out = answers
    texts = {}
    for r in out:
        texts.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in texts.values()) and texts[None] == texts[0]
    assert texts[1000] == texts[1001]
    assert [r.held_out for r in out if r.doc_id is None] == [False]


def test_given_labels(spark):
    rows = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    out = toxicity.toxicity(rows, labels)
    found = out.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    good, bad = found[found.toxic == 0], found[found.toxic == 1]
    above = np.mean(bad.score.to_numpy()[:, None] > good.score.to_numpy()) + 0.5 * np.mean(bad.score.to_numpy()[:, None] == good.score.to_numpy())
    assert above >= 0.97 and bad.predicted.mean() >= 0.9 and good.predicted.mean() <= 0.02


def test_only_the_text_decides_and_held_out_labels_teach_nothing(spark):
    rows, labels = invented(240)
    other = [(i, 1 - t if held(i) else t) for i, t in labels]
    both = []
    for kept, source in ((labels, "a"), (other, "b")):
        df = docs(spark, [(i, t, source, source) for i, t in rows])
        both.append(sorted(map(tuple, toxicity.toxicity(df, spark.createDataFrame(kept, LABELS)).collect())))
    assert both[0] == both[1]


def test_nothing_to_learn(spark):
    df, none = docs(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity(df, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], LABELS)
    assert {(r.score, r.predicted) for r in toxicity.toxicity(df, ones).collect()} == {(1.0, 1)}
    rows, labels = invented(60)
    assert toxicity.toxicity(docs(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []


def test_a_copied_passage_teaches_no_words(spark):
    """Its words stand in one context each, however many texts copy it."""
    passage = " ".join(prose(99, 30))
    rows = [(i, f"{' '.join(prose(i, 30))} {passage if i % 2 else ''} {' '.join(prose(1000 + i, 30))}") for i in range(300)]
    sample = docs(spark, rows).select("text", F.pmod("doc_id", F.lit(3)).cast("int").alias("fold"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    numbers = {(f, t): 50 for f in range(3) for t in (0, 1)}
    found = toxicity._lexicons(sample, numbers)[-1].units
    assert not set(toxicity._hashes([w for w in passage.split()[1:] if len(w) > 4])) & set(found)


def test_counts_are_those_of_a_plain_reading():
    texts = ["You stupid IDIOT!! you are TRASH", "", "nice day, ist du da", "an id1ot and st.upid  w-o-r-d", "sooo baaad?! i d i o t", "ÄÖÜ ß Éa"]
    lexicon = toxicity.Lexicon(toxicity._hashes(["stupid", "trash"]))
    counts = toxicity._counts_of(pa.array(texts), lexicon)
    for text, row in zip(texts, counts, strict=True):
        words = re.findall(r"[^\s!-/:-@\[-`{-~]+", text.lower())
        assert row[0] == len(words) and row[2] == len(text.encode())
        assert row[3] == sum(w in toxicity.SECOND_PERSON for w in words)
        assert row[4] == sum(w in toxicity.INSULTS for w in words)
        assert row[5] == sum(w in ("stupid", "trash") for w in words)
        assert row[8] == sum(c.isupper() for c in text)
        assert row[10] == sum(c in "!?" for c in text)
    assert counts[0][7] == 3 and counts[0][9] == 2 and counts[0][11] == 1 and counts[0][16] == 3
    assert counts[3][12] == 3 and counts[3][13] == 2
    assert counts[4][14] == 2 and counts[4][15] == 2


def test_a_long_text_is_cut_at_white_space_and_summed():
    text = " ".join(["you stupid fool and so on"] * 80_000)
    pieces = toxicity._pieces(text)
    assert "".join(pieces) == text and len(pieces) == 2
    lexicon = toxicity.Lexicon(toxicity._hashes(["stupid"]))
    whole, short = (toxicity.features(pa.array([t]), lexicon)[0] for t in (text, "you stupid fool and so on " * 1000))
    assert np.allclose(whole[2:], short[2:], rtol=1e-3)
