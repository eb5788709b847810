"""Fingerprints: edited texts, likeness, and sketches next to multisets."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from llm.helpers import docs, odd_texts, prose

from garoa.llm import fingerprints as fp


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a, b):
    sets = [Counter(fp.paragraphs([t])[0].tolist()) for t in (a, b)]
    union = sum((sets[0] | sets[1]).values())
    return sum((sets[0] & sets[1]).values()) / union if union else 1.0


def check(spark, rows, df):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    want = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        want.setdefault(i, []).append((text or "", after or ""))
    out = fp.fingerprints(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            continue
        matching = [(t, n) for t, n in want[r.doc_id] if hashlib.sha256(edited(t, n).encode()).hexdigest() == r.edited_sha256 and len(t) == r.n_chars]
        assert matching
        text, after = matching[0]
        assert abs(r.near_edited - likeness(text, edited(text, after))) < 1e-12
        assert abs(r.near_next - likeness(text, after)) < 1e-12
    return out


def test_odd_rows(spark):
    rows = [(10 * i, t) for i, t in enumerate(odd_texts())] + [(-5, "a b c"), (5, " ".join(prose(4, 200))), (6, " ".join(prose(4, 200)))]
    out = {r.doc_id: r for r in check(spark, rows, docs(spark, rows, "part ahead to fingerprint"))}
    assert out[5].fingerprint == out[6].fingerprint != out[-5].fingerprint and out[5].near_next == 1.0


def test_many_ranges_and_a_near_copy(spark):
    rows = [(7 * i, " ".join(prose(i, 40))) for i in range(400)]
    out = check(spark, rows, docs(spark, rows))
    assert all(r.near_next < 0.1 < r.near_edited < 0.9 for r in out)


def test_lone_rows_null_ids_and_no_rows(spark):
    assert fp.fingerprints(docs(spark, [(3, "abcd")])).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    out = fp.fingerprints(docs(spark, [(None, "abcd"), (None, None), (1, "x"), (1, "x")])).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.near_next) for r in out) == [(0, 0, 1.0), (0, 4, 1.0), (1, 1, 1.0), (1, 1, 1.0)]
    assert fp.fingerprints(docs(spark, [])).collect() == []


def test_peeling_recovers_what_differs_and_grows_until_it_does():
    one, two = prose(1, 900), prose(1, 450) + prose(2, 300)
    a, b = fp.paragraphs([" ".join(one)]), fp.paragraphs([" ".join(two)])
    own, other = set(a[0].tolist()), set(b[0].tolist())
    cells = 3000
    (c1, k1, h1), (c2, k2, h2) = (fp.sketch(*x, 1, cells) for x in (a, b))
    digests, _, sign, whole = fp.peel(c1 - c2, k1 ^ k2, h1 ^ h2)
    assert whole.all() and set(digests[sign > 0].tolist()) == own - other and set(digests[sign < 0].tolist()) == other - own
    few = fp.sketch(*a, 1, fp.CELLS)
    assert not fp.peel(*few)[3].all()
    assert fp.differences(a, b, 1)[0] == len(own ^ other)
    assert np.array_equal(fp.differences(a, a, 1), [0])
