"""The stages of the corpus pipeline, each on its own input."""

from __future__ import annotations

import re
import tempfile

import corpus_pipeline
import pytest
from llm.helpers import docs, prose
from llm.test_decontaminate import brute as leaks_of
from llm.test_near_dedup import brute as groups_of
from llm.test_substring import brute as kept_of
from pyspark.sql import functions as F

from garoa.llm import language
from garoa.llm.shared import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_each_stage_next_to_brute_force(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    before, folder = table(spark, SF, "documents"), tempfile.mkdtemp(prefix="stages-")
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        old, new = rows_of(before), dict(rows_of(after))
        if name == "language":
            said = {r.doc_id: r.lang_pred for r in language.identify(before).collect()}
            assert set(new) == {d for d, _ in old if said[d] != "und"}
        elif name == "near_duplicates":
            assert set(new) == {d for d, (_, c) in groups_of(old).items() if c == d}
        elif name == "repeated_passages":
            want = kept_of(old)
            assert set(new) == {d for d, (n, gone, _) in want.items() if not gone or gone < n}
            assert all(new[d] == (k if gone else dict(old)[d]) for d, (_, gone, k) in want.items() if d in new)
            assert all(r.n_chars == len(r.text) for r in after.collect() if want[r.doc_id][1])
        elif name == "decontamination":
            assert set(new) == {d for d, _ in old} - {d for d, _ in leaks_of(old, items)}
        else:
            sizes = {d: len(WORD.findall(t)) for d, t in old}
            assert all(0 < r.taken <= 2 * sizes[r.doc_id] for r in after.collect())
            total = after.agg(F.sum("taken")).first()[0]
            assert abs(total - 1.5 * sum(sizes.values())) < 30
        assert after.columns == columns + ["taken"] * (name == "mixing")
        before = after


def test_stages_take_odd_rows_extra_columns_and_no_rows(spark):
    long = " ".join(prose(5, 60))
    rows = [(None, "words without id " + long), (1, None), (2, long), (2, long), (3, long), (4, ""), (5, "12 34")]
    odd = docs(spark, rows, "taken kept n_words rows words rest component_id id size language").withColumn("source", F.lit(None).cast("string"))
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert set(df.columns) == set(out.columns), name
            out.collect()


def test_run_is_repeatable(spark):
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "taken").collect())) for _ in range(2))
    assert first == second and len(first) > 50


def stored(spark, tmp_path, df):
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_one_row_stays_of_copies_with_repeated_and_missing_ids(spark, tmp_path):
    text = " ".join(prose(3, 60))
    other = " ".join(prose(4, 60))
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (None, other), (None, other), (5, None), (None, None), (6, "")]
    kept = corpus_pipeline.one_of_near_copies(spark, stored(spark, tmp_path, docs(spark, rows, "component_id kept")), SF).collect()
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in kept)
    assert found == sorted([((False, 1), text), ((True, 0), other), ((False, 5), ""), ((True, 0), ""), ((False, 6), "")])


@pytest.mark.parametrize(("n", "words", "size"), [(4, "one", 6), (3, "one two three", 13)])
def test_mix_loses_no_words_of_equal_rows(spark, tmp_path, n, words, size):
    table = stored(spark, tmp_path, docs(spark, [(1, words, "en", "s")] * n))
    taken = [r.taken for r in corpus_pipeline.mixed(spark, table, SF).collect()]
    assert sum(taken) == size and max(taken) <= 2 * len(words.split())
