"""Near duplicates next to all pairs."""

from __future__ import annotations

import random
import re

from llm.helpers import docs, odd_texts, prose

from garoa.llm import near_dedup
from garoa.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    while True:
        before = dict(label)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {d: (len(sets[d]), label[d]) for d in sets}


def near_rows(groups: int, copies: int, edits: int):
    """Groups of a text and copies with some words changed."""
    draw, rows = random.Random(5), []
    for g in range(groups):
        base = prose(100 + g, 80)
        for c in range(copies):
            words = list(base)
            for _ in range(draw.randint(0, edits)):
                words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
            rows.append((1000 * g + c, " ".join(words)))
    return rows


def answers(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}


def test_groups_and_odd_texts(spark):
    rows = near_rows(12, 6, 5) + [(90_000 + i, t) for i, t in enumerate(odd_texts())]
    df = docs(spark, rows, "id n tokens grp m kept component chunk")
    assert answers(df) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_dedup.near_duplicates(df).collect())


def test_large_groups_branch_and_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 8)
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    monkeypatch.setattr(near_dedup, "DEPTH", 2)
    rows = near_rows(2, 40, 9)
    assert answers(docs(spark, rows)) == brute(rows)


def test_shared_passage_is_no_link(spark):
    passage = " ".join(prose(7, 15))
    rows = [(i, " ".join(prose(200 + i, 60)) + " " + passage) for i in range(150)]
    assert answers(docs(spark, rows)) == brute(rows)


def test_exact_threshold(spark):
    base = prose(3, 39)
    rows = [(1, " ".join(base)), (2, " ".join(base[:34])), (3, " ".join(base[:30])), (4, " ".join(base[:31])), (5, " ".join(base).upper())]
    assert answers(docs(spark, rows)) == brute(rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    text = " ".join(prose(9, 30))
    out = near_dedup.near_duplicates(docs(spark, [(None, text), (4, text), (4, text), (7, text)])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in out) == [(0, None, True), (4, 4, True), (4, 4, True), (7, 4, False)]
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []


def test_components_of_a_chain_a_hub_and_loops(spark):
    chain = [(i, i + 1) for i in range(40, 80)]
    hub = [(100, 100 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + hub + [(7, 7), (None, 3), (9, 8), (8, 9)], "a long, b long")
    out = {r.id: r.component for r in components(edges).collect()}
    assert out == {i: 40 for i in range(40, 81)} | {i: 100 for i in range(100, 150)} | {7: 7, 8: 8, 9: 8}


def test_texts_of_equal_sets_are_one_class(spark):
    """A line repeated 2, 3, ... times: over 100 sequences of one set, and neighbours a little above likeness 0.75."""
    line = prose(31, 20)
    rows = [(k, " ".join(line * (k + 2))) for k in range(150)]
    rows += [(1000 + x, " ".join(line * 2 + prose(600 + x, 6))) for x in range(4)]
    out = near_dedup.sketches(docs(spark, rows)).where("doc_id < 1000")
    assert out.select("high", "low").distinct().count() == 1
    assert answers(docs(spark, rows)) == brute(rows)


def test_large_nodes_of_the_same_members_branch_apart(spark, monkeypatch):
    """Families of 9 equal sketches and one that shares three quarters of their tokens."""
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 8)
    draw, rows = random.Random(8), []
    for f in range(200):
        tokens = [draw.randrange(1 << 30) for _ in range(near_dedup.TOKENS)]
        near = [t if draw.random() < 0.75 else draw.randrange(1 << 30) for t in tokens]
        rows += [(10 * f + i, 100, tokens) for i in range(9)] + [(10 * f + 9, 100, near)]
    sketched = spark.createDataFrame(rows, "id long, n long, tokens array<int>")
    found = {r.id: r.component for r in components(near_dedup.likely_links(sketched)).collect()}
    assert [f for f in range(200) if found.get(10 * f + 9) != 10 * f] == []
