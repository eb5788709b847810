"""Hard negatives: products and lists against brute force, passes, wide fields, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from garoa.llm import hard_negatives
from garoa.llm.hard_negatives import Packing

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract, pair by pair; ``rows`` of distinct ids."""
    good = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, va, la in good:
        if a % 50:
            continue
        near = sorted((-score(va, v), i) for i, v, label in good if label == la and i != a)[:5]
        far = sorted((-score(va, v), i) for i, v, label in good if label != la)
        for p, i in near:
            kept = [(-n, j) for n, j in far if 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, i, k, j, -p, n) for k, (n, j) in enumerate(kept, 1)]
    return sorted(out)


def mine(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS anchor", "2 AS score", "'x' AS is_anchor")
    return sorted(map(tuple, hard_negatives.hard_negatives(df.repartition(5), F.col("vec_id") % 50 == 0, **options).collect()))


def vectors(n, seed=3, dim=8, step=0.01):
    draw = random.Random(seed)
    return [(i, [round(draw.uniform(-1, 1) / step) * step for _ in range(dim)], draw.choice([0, 0, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("step", [0.01, 0.5])
def test_lists_equal_brute_force_with_ties(spark, step):
    rows = vectors(700, step=step)
    assert mine(spark, rows) == brute(rows) and len(brute(rows)) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [0.5] * 8, 1), (1000, None, 1), (1001, [0.5] * 7 + [None], 1), (1002, [nan] * 8, 0), (1050, [inf] * 8, 0), (1100, [0.5] * 8, None)]
    short = [(1150, [], 0), (1200, [0.9, 0.9], 0), (1201, [0.9, 0.8], 0), (1202, [0.4, 0.6] * 5, 1)]
    rows = vectors(120) + odd + short
    assert mine(spark, rows) == brute(rows)
    assert mine(spark, odd) == [] and mine(spark, []) == [] and mine(spark, [(1, [0.5], 1)]) == []
    assert mine(spark, [(50, [0.5], 1)]) == []


def test_passes_give_the_same_and_repeated_anchors_are_answered_each(spark):
    rows = vectors(600)
    assert mine(spark, rows, pass_bytes=200) == brute(rows)
    twice = mine(spark, [*vectors(120), vectors(120)[50]])
    assert twice == sorted(r for r in brute(vectors(120)) for _ in range(2 if r[0] == 50 else 1))


def test_a_hot_vector_is_told_apart_by_id(spark):
    rows = vectors(200) + [(i, [0.25] * 8, i % 2) for i in range(1000, 2500)]
    assert mine(spark, rows) == brute(rows)


def test_wide_components(spark):
    rows = [(i, [x * 4000.0 for x in v], label) for i, v, label in vectors(160)]
    assert mine(spark, rows) == brute(rows)
    with pytest.raises(ValueError, match="fit a long"):
        mine(spark, [(50, [1e9] * 8, 1), (1, [1e9] * 8, 1)])


@pytest.mark.parametrize(("low", "high", "dim"), [(-256, 256, 64), (-3, 0, 5), (0, 1, 1), (-256, 256, 3000), (-(1 << 20), 1 << 20, 16), (-(1 << 26), 1 << 26, 16), (0, 0, 0)])
def test_fields_never_run_into_each_other(low, high, dim):
    draw = np.random.default_rng(0)
    packing = Packing(dim, low, high)
    assert packing.kind is object or packing.width * packing.fields <= 53
    for n in (1, packing.fields, 13):
        rows = draw.integers(low, high + 1, (n, dim))
        if n > 2:
            rows[0], rows[1] = low, high
        found = packing.products(rows, packing.pack(rows), rows)
        assert (found == rows @ rows.T).all()


def test_two_scores_a_product_at_the_given_size():
    assert Packing(64, -160, 154).fields == 2 and Packing(16, -8, 8).fields == 4
