"""Fill in the middle: cuts against a plain split, exact round trips, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import docs, odd_texts
from pyspark.sql import functions as F

from garoa.llm import fill_middle
from garoa.llm.shared import offsets_of

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
EDGES = ["\n", "\n\n\n", "a\n", "\na", "é\n漢字\n\U0001f600", "a\r\nb\x0bc d", "<P", "x<\nS>", "<S>", "a <M> b", "<p>", "l\n" * 5000, "no end " * 3000]


def plainly(doc_id, text, seed=7, rate=100, spm=50):
    """The contract, one text at a time."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, len(units))))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, len(units), form, len(p), len(m), out)


def rows_of(draw: random.Random) -> list:
    texts = odd_texts() + EDGES + ["".join(draw.choice("ab\n é漢") for _ in range(draw.randint(0, 400))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (None, None), (3, "one\ntwo\n"), (3, "one\ntwo\n"), (-5, "x\ny")]


def test_outputs_equal_the_plain_cut_and_restore_the_text(spark):
    rows = rows_of(random.Random(1))
    df = docs(spark, rows, "n form output h1 prefix_chars")
    out = fill_middle.fill_middle(df).withColumn("text", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted((plainly(*r) for r in rows), key=key)
    assert sorted((repr(r.doc_id), r.text) for r in out) == sorted((repr(i), t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in out}


def test_rate_seed_and_order_are_parameters(spark):
    rows = [(i, "a\nb\nc\nd\n") for i in range(300)]
    out = fill_middle.fill_middle(docs(spark, rows), seed=11, rate=40, suffix_first=10).collect()
    assert sorted(map(tuple, out)) == sorted(plainly(*r, 11, 40, 10) for r in rows)
    assert 80 < sum(r.form != "plain" for r in out) < 160
    assert fill_middle.fill_middle(docs(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\n漢é", max_size=60), min_size=1, max_size=8), st.integers(0, 10**6))
def test_ranks_of_skip_lists(texts, seed):
    draw = random.Random(seed)
    lists = fill_middle.SkipLists(*offsets_of(pa.array(texts)))
    units = [UNIT.findall(t) for t in texts]
    assert lists.units.tolist() == list(map(len, units))
    ranks = [draw.randint(0, len(u)) for u in units]
    got = lists.code_points(np.arange(len(texts)), np.array(ranks))
    assert got.tolist() == [len("".join(u[:r])) for u, r in zip(units, ranks, strict=True)]


def test_lanes_thin_out_and_a_rank_takes_few_steps():
    text = "".join("x" * (i % 7) + "\n" for i in range(100_000))
    lists = fill_middle.SkipLists(*offsets_of(pa.array([text])))
    sizes = [len(lane[0]) for lane in lists.lanes]
    assert sizes[-1] <= 2 and all(b < 0.4 * a for a, b in zip(sizes[:6], sizes[1:7], strict=True))
    ranks = np.array([0, 1, 49_999, 99_999, 100_000])
    ends = np.append(0, np.cumsum([i % 7 + 1 for i in range(100_000)]))
    assert lists.code_points(np.zeros(5, int), ranks).tolist() == ends[ranks].tolist()
