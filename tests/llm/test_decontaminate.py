"""Benchmark items in documents next to all windows."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import docs, odd_texts, prose

from garoa.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(rows, items):
    out = {}
    for d, t in rows:
        w = [x.lower() for x in WORD.findall(t or "")]
        for i, it in items:
            v = [x.lower() for x in WORD.findall(it or "")]
            if not v or not w:
                continue
            k, n = min(5, len(v)), len(v)
            own, best = Counter(grams(v, k)), 0.0
            for s in range(max(1, len(w) - n + 1)):
                c = Counter(grams(w[s : s + n], k))
                both = sum((c & own).values())
                best = max(best, both / (sum(own.values()) + sum(c.values()) - both))
            if best >= 0.75:
                out[d, i] = round(best, 9)
    return out


def case():
    draw = random.Random(4)
    items = [(i, " ".join(prose(i, draw.randint(5, 40)))) for i in range(25)]
    items += [(50, "tiny"), (51, "a b c"), (52, None), (53, ""), (54, "x " * 12), (55, " ".join(prose(3, 30)).upper())]
    rows = []
    for d in range(120):
        words = prose(900 + d, draw.randint(0, 80))
        item = draw.choice(items)[1] or ""
        for _ in range(draw.randint(0, 2)):
            put = item.split()
            for _ in range(draw.randint(0, 4)):
                if put:
                    put[draw.randrange(len(put))] = "other"
            if draw.random() < 0.3:
                put = put[draw.randint(0, 3) :]
            at = draw.randint(0, len(words))
            words = words[:at] + put + words[at:]
        rows.append((d, " ".join(words)))
    return rows + [(500 + i, t) for i, t in enumerate(odd_texts())] + [(600, "x " * 400), (601, "Tiny"), (602, "a b c d")], items


def test_next_to_all_windows(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    df = docs(spark, rows, "item_id likeness start_word")
    out = decontaminate.leaks(df, bench).collect()
    found = {(r.doc_id, r.item_id): round(r.likeness, 9) for r in out}
    want = brute(rows, items)
    assert found == want and len(out) == len(want) and len(want) > 20
    for r in out:
        words = WORD.findall(dict(rows)[r.doc_id].lower())[r.start_word : r.start_word + r.n_words]
        assert brute([(0, " ".join(words))], [(r.item_id, dict(items)[r.item_id])])[0, r.item_id] == round(r.likeness, 9)
    kept = {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}


def test_passes_find_the_same(spark, monkeypatch):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs(spark, rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 1500)
    assert sorted(map(tuple, decontaminate.leaks(docs(spark, rows), bench).collect())) == whole


@pytest.mark.parametrize("words", [1, 7, 23])
def test_blocks_of_long_rows_find_the_same(monkeypatch, words):
    rows, items = case()
    index, column = decontaminate.build_index(items), pa.array([t for _, t in rows], pa.string())
    whole = decontaminate.matches(index, column)
    assert len(whole) > 20
    monkeypatch.setattr(decontaminate, "_CHUNK_WORDS", words)
    assert decontaminate.matches(index, column) == whole


def test_memory_of_a_very_long_text():
    item = " ".join(prose(1, 20))
    index = decontaminate.build_index([(1, item), (2, "tiny word")])
    common = prose(1, 20)[:9]
    text = " ".join([*(prose(2, 100) * 4_000), *(common * 10_000), "tiny word " * 100_000, item, *prose(3, 50)])
    tracemalloc.start()
    found = decontaminate.matches(index, pa.array([text], pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(m[1], m[2], m[5]) for m in found] == [(0, 690_000, 1.0), (1, 490_000, 1.0)]
    assert peak < 33 * len(text)


def test_blocks_find_every_fingerprint_within_the_radius():
    draw = np.random.default_rng(0)
    prints = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = prints.repeat(24)
    for n in range(len(near)):
        for bit in draw.choice(64, n % 24, replace=False):
            near[n] ^= np.uint64(1) << np.uint64(bit)
    index = decontaminate.build_index([(i, " ".join(prose(i, 9))) for i in range(40)])
    lists = {}
    bits = np.array([bin(v).count("1") for v in range(256)])
    ok = np.flatnonzero(bits <= decontaminate.NEAR)
    for b in range(decontaminate.BLOCKS):
        values = (decontaminate._block(prints, b)[:, None] ^ ok[None, :]).ravel()
        order = np.argsort(values, kind="stable")
        lists[9, b] = (np.searchsorted(values[order], np.arange(257)), np.repeat(np.arange(40), len(ok))[order])
    index.fingerprint, index.lists = prints, lists
    window, item, _ = decontaminate._candidates(index, 9, near)
    found = set(zip(window.tolist(), item.tolist(), strict=True))
    far = np.bitwise_count(near[:, None] ^ prints[None, :])
    assert found == set(zip(*np.nonzero(far <= decontaminate.RADIUS), strict=True))


def test_null_ids_repeated_rows_and_nothing(spark):
    item = " ".join(prose(1, 20))
    bench = spark.createDataFrame([(None, item), (1, item)], "item_id long, text string")
    out = decontaminate.leaks(docs(spark, [(None, item), (2, item), (2, item)]), bench).collect()
    assert len(out) == 6 and {r.likeness for r in out} == {1.0}
    assert decontaminate.leaks(docs(spark, []), bench).collect() == []
    assert decontaminate.leaks(docs(spark, [(1, item)]), bench.limit(0)).collect() == []
    assert decontaminate.without_leaks(docs(spark, [(1, item)]), bench.limit(0)).count() == 1
