"""Language: held-out accuracy, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
from llm.helpers import docs

from garoa.llm import language
from garoa.llm.shared import table


def test_held_out_accuracy(spark):
    rows = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in rows.select("doc_id", "lang").collect()}
    out = language.identify(rows.selectExpr("*", "'x' AS language", "1.0 AS score")).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(truth)


def test_only_the_text_decides_and_held_out_rows_teach_nothing(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents")
    other = rows.withColumn("source", rows.lang).withColumn("n_chars", rows.doc_id)
    wrong = other.withColumn("lang", language.F.when(language.held_out(), "zz").otherwise(other.lang))
    answers = [sorted(map(tuple, language.identify(df).collect())) for df in (rows, wrong)]
    assert answers[0] == answers[1]


def test_texts_without_letters_long_texts_ties_and_nothing(spark):
    long = "der die das und ist nicht " * 20_000
    teach = [(i, t, lang) for i, (t, lang) in enumerate([("der die das und nicht ein", "de"), ("the and of is not a", "en")] * 30)]
    odd = [(900, None, None), (901, "", "de"), (902, "12 -- !", "en"), (903, long, None), (None, "the and of", "en"), (904, "the and of", None), (904, "the and of", None)]
    out = [(r.doc_id, r.held_out, r.lang_pred) for r in language.identify(docs(spark, teach + odd)).collect()]
    said = {d: p for d, _, p in out}
    assert len(out) == 67 and [said[d] for d in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "de", "en", "en"]
    assert (None, False, "en") in out
    assert language.identify(docs(spark, [])).collect() == []
    alone = language.identify(docs(spark, [(1, "words", None)])).first()
    assert (alone.lang_pred, alone.score) == ("und", 0.0)


def test_presence_counts_grams_inside_rows_only():
    data = np.frombuffer(b"abAB", np.uint8)
    both = language.presence(data, np.array([0, 2, 4]))
    assert (both[0] == both[1]).all() and both[0].sum() == 3
    assert language.presence(np.zeros(0, np.uint8), np.array([0, 0])).sum() == 0


def _spoken(letters: str, seed: int, n: int) -> str:
    """Words of an invented language, drawn from all that its letters make."""
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list(letters), draw.integers(3, 9))) for _ in range(n))


def test_long_texts_of_a_large_vocabulary(spark):
    two = {"aa": "abcdefghijklmnoprst", "bb": "bcdefghiklmnprstuvwxyz"}
    teach = [(i, _spoken(two[lang], i, 60), lang) for i, lang in enumerate(["aa", "bb"] * 80)]
    long = [(1000 + i, _spoken(two[lang], 5000 + i, n), None) for i, (lang, n) in enumerate((a, n) for n in (1000, 20_000, 200_000) for a in two)]
    said = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(spark, teach + long)).collect()}
    assert [said[r[0]][0] for r in long] == ["aa", "bb"] * 3
    assert all(said[r[0]][1] > 0.65 for r in long)


def test_parts_cover_each_text_once():
    for text in ("", "a", "word " * 9000, "x" * 40_000, "漢" * 20_000):
        data = np.frombuffer(text.encode() * 2, np.uint8)
        bounds, rows = language.parts(data, np.array([0, len(text.encode()), len(data)]))
        assert bounds[0] == 0 and bounds[-1] == len(data) and (np.diff(bounds) >= 0).all()
        assert sorted(set(rows)) == [0, 1] and np.diff(bounds).max() <= language.PART_BYTES * 3 // 2
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            data[a:b].tobytes().decode()


def test_sample_holds_one_row_of_an_id(spark):
    rows = [(7, f"the and of {i}", "en") for i in range(400)] + [(i, "der die das", "de") for i in range(8, 20)]
    model = language.fit(docs(spark, rows))
    assert len(model.bits) == 13 and model.languages == ["de", "en"]


def test_scores_are_those_of_the_plain_kernel(spark):
    """With all rows as landmarks: presence of n-grams in common, ridge regression on the whole kernel."""

    def grams(text):
        raw = text.lower().encode()
        return {raw[i : i + k] for k in language.GRAMS for i in range(len(raw) - k + 1)}

    def near(a, b):
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    words = {"en": "the and of is not a with from", "de": "der die das und nicht ein mit von", "fr": "le la les et pas un avec de"}
    draw = np.random.default_rng(4)
    texts = [(i, " ".join(draw.choice(words[lang].split(), 12)), lang) for i, lang in enumerate(["en", "de", "fr"] * 12)]
    model = language.fit(docs(spark, texts))
    held = [(100 + i, " ".join(draw.choice(words[lang].split(), 9)), None) for i, lang in enumerate(["en", "de", "fr"] * 5)]
    got = {r.doc_id: (r.l.lang_pred, r.l.score) for r in language.with_language(docs(spark, held), model, "l").collect()}
    sets = [grams(t) for _, t, _ in texts]
    names = ["de", "en", "fr"]
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for _, _, lang in texts])
    kernel = np.array([[near(a, b) for b in sets] for a in sets])
    weight = 1 / 12
    solved = np.linalg.solve(kernel * weight + language.RIDGE * np.eye(len(sets)), y * weight)
    for i, text, _ in held:
        scores = np.clip((np.array([near(grams(text), b) for b in sets]) @ solved + 1) / 2, 0, 1)
        assert got[i][0] == names[scores.argmax()] and abs(got[i][1] - scores.max()) < 0.05
