"""Mixing: targets, flows of least cost, and what documents give."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from llm.helpers import docs, odd_texts, prose
from pyspark.sql import functions as F

from garoa.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_stop_at_the_limit_and_share_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == [200.0, 500 / 3, 250 / 3]
    assert mixing.targets([10, 1000, 0], [5, 2, 1], 1515) == [20.0, 1495.0, 0.0]
    assert mixing.targets([], [], 0) == []


def cost(flow, patterns):
    total = 0
    for given, (_, size) in zip(flow, patterns, strict=True):
        words = sum(given.values())
        total += sum(e * max(0, min(words - e * size, size)) for e in range(3))
    return total


def test_flow_is_least_cost_next_to_all_flows():
    draw = random.Random(3)
    for _ in range(25):
        patterns = [(s, draw.randint(0, 3)) for s in ([0], [1], [0, 1], [1, 2])]
        quotas = [draw.randint(0, 4) for _ in range(3)]
        flow = mixing.min_cost_flow(patterns, quotas, 2)
        assert all(sum(g.values()) <= 2 * size for g, (_, size) in zip(flow, patterns, strict=True))
        best = None
        arcs = [(p, s) for p, (members, _) in enumerate(patterns) for s in members]
        for amounts in itertools.product(range(5), repeat=len(arcs)):
            given = [{} for _ in patterns]
            for (p, s), a in zip(arcs, amounts, strict=True):
                given[p][s] = a
            if any(sum(g.values()) > 2 * size for g, (_, size) in zip(given, patterns, strict=True)):
                continue
            got = [sum(g.get(s, 0) for g in given) for s in range(3)]
            if any(g > q for g, q in zip(got, quotas, strict=True)):
                continue
            value = (-sum(got), cost(given, patterns))
            best = value if best is None else min(best, value)
        assert (-sum(sum(g.values()) for g in flow), cost(flow, patterns)) == best


def test_sources_come_to_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    draw = random.Random(1)
    rows = [(i, " ".join(prose(i, draw.randint(0, 60))), "en", draw.choice(["a", "b", "b", "é", None])) for i in range(300)]
    rows += [(1000 + i, t, "en", "odd") for i, t in enumerate(odd_texts())] + [(None, "x y", "en", "b"), (7, rows[7][1], "en", "a")]
    df = docs(spark, rows, "size taken target sources words bucket place")
    out = mixing.mix(df, F.array("source")).collect()
    words = sorted((r[0] or -1, len(WORD.findall(r[1] or ""))) for r in rows)
    assert sorted((r.doc_id or -1, r.size) for r in out) == words
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(t.words for t in r.takes)
        taken[r.sources[0]] += r.taken
        target[r.sources[0]] = r.target
    assert all(abs(taken[s] - t) < 1 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(n for _, n in words)) < 1e-6
    again = mixing.mix(df, F.array("source")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_overlapping_sources_share_documents(spark):
    rows = [(i, " ".join(prose(i, 10))) for i in range(60)]
    df = docs(spark, rows).withColumn("of", F.expr("CASE WHEN doc_id % 3 = 0 THEN array('a') WHEN doc_id % 3 = 1 THEN array('b', 'a') ELSE array('b', null, 'b') END"))
    out = mixing.mix(df, F.col("of"), weigh=lambda n: [1.0] * n).collect()
    by = Counter()
    for r in out:
        assert r.taken <= 2 * r.size
        for t in r.takes:
            by[t.source] += t.words
    assert by == {"=a": 300, "=b": 300, "null": 300}


def test_no_rows(spark):
    assert mixing.mix(docs(spark, []), F.array("source")).collect() == []


def test_sources_of_their_own_need_no_flow():
    patterns = [([0], 50), ([1], 10), ([2, 3], 40), ([3], 5), ([], 3)]
    quotas = [70, 40, 30, 60]
    assert mixing.routed(patterns, quotas) == mixing.min_cost_flow(patterns, quotas)
    many = [([i], 10) for i in range(100_000)]
    assert mixing.routed(many, [15] * 100_000)[-1] == {99_999: 15}
    with pytest.raises(ValueError, match="membership patterns"):
        mixing.routed([([i, i + 1], 1) for i in range(5000)], [1] * 5001)


def test_rows_without_id_are_spread_by_text(spark):
    rows = spark.range(3000).selectExpr("cast(null as long) doc_id", "concat('w ', id) text", "'s' source")
    out = mixing.mix(rows, mixing.F.array("source"), share=0.5)
    assert out.agg(mixing.F.sum("taken")).head()[0] == 3000
    assert 1400 < out.where("taken > 0").count() < 1600
