"""Repeated passages next to a dictionary of all windows."""

from __future__ import annotations

import random
import re
import uuid
from pathlib import Path

import numpy as np
from llm.helpers import docs, odd_texts, prose

from garoa.llm import substring
from garoa.llm.fm_index import FMIndex, RangeMinimum, WaveletMatrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        out[d] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g))
    return out


def answers(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()}


def shared_rows(n: int):
    draw, parts = random.Random(2), [prose(300 + i, 70) for i in range(8)]
    rows = []
    for d in range(n):
        words = prose(1000 + d, draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(parts)
            a = draw.randrange(60)
            words += p[a : a + draw.randint(5, 60)] + prose(5000 + d, draw.randint(0, 5))
        rows.append((d, " ".join(words)))
    return rows


def test_shared_passages_periodic_and_odd_texts(spark):
    rows = shared_rows(80) + [(900 + i, t) for i, t in enumerate(odd_texts())]
    rows += [(950, "a b c d e " * 40), (951, "a b c d e\n" * 9), (952, rows[3][1]), (953, "p q " * 30 + "r " * 45)]
    assert answers(docs(spark, rows, "cuts low high anchor segments kept n_words")) == brute(rows)


def test_small_indexes_and_crowded_anchors(spark, monkeypatch):
    rows = shared_rows(60)
    monkeypatch.setattr(substring, "CROWD", 1)
    assert answers(docs(spark, rows)) == brute(rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    text = " ".join(prose(11, 40))
    out = substring.remove_repeats(docs(spark, [(None, text), (5, text), (5, text), (6, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (5, 0), (5, 0), (6, 40)]
    assert substring.remove_repeats(docs(spark, [])).collect() == []


def test_carried_columns(spark):
    out = substring.remove_repeats(docs(spark, [(1, "a"), (2, None)]), ("doc_id", "lang")).collect()
    assert sorted((r.doc_id, r.lang, r.kept) for r in out) == [(1, "en", "a"), (2, "en", "")]


def test_backward_search_and_ranks():
    draw = np.random.default_rng(0)
    text = draw.integers(1, 6, 300)
    wavelet = WaveletMatrix(text, 3)
    for c in range(1, 6):
        low, high = wavelet.rank(np.array([c]), np.array([17]), np.array([211]))
        assert (low[0], high[0]) == ((text[:17] == c).sum(), (text[:211] == c).sum())
    values = draw.integers(0, 99, 77)
    assert RangeMinimum(values).least(np.array([3]), np.array([60]))[0] == values[3:60].min()
    first = np.arange(0, 301, 30)
    index = FMIndex(text, first, np.arange(300), 40)
    begin, end = index.matches(first, 4)
    found = {s for b, e in zip(begin, end, strict=True) for s in range(b, e - 3)}
    own = [s for s in range(297) if s // 30 == (s + 3) // 30]
    expected = {s for s in own if any(tuple(text[s : s + 4]) == tuple(text[r : r + 4]) for r in own if r < s)}
    assert found == expected


def test_a_crowded_anchor_is_never_indexed_whole(spark, monkeypatch, tmp_path):
    """Each text has its own words before a shared passage: as many different segments of an anchor as texts."""
    passage, folder, shard = prose(77, 30), str(tmp_path), substring._shard
    rows = [(d, " ".join(prose(20_000 + d, 25) + passage)) for d in range(90)]
    rows += [(500 + d, t) for d, t in shared_rows(10)]

    def counted(batches):
        held = list(batches)
        anchors = np.concatenate([b.column("anchor").to_numpy() for b in held] or [np.zeros(0, np.int64)])
        most = int(np.unique(anchors, return_counts=True)[1].max(initial=0))
        Path(folder, f"{uuid.uuid4().hex}-{most}").touch()
        yield from shard(iter(held))

    monkeypatch.setattr(substring, "CROWD", 20)
    monkeypatch.setattr(substring, "_shard", counted)
    assert answers(docs(spark, rows)) == brute(rows)
    sizes = [int(p.name.split("-")[1]) for p in tmp_path.iterdir()]
    assert sizes
    assert max(sizes) <= 20
