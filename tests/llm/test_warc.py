"""Fixity audit: damage of small replicas, record by record."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from garoa.llm import warc

SCHEMA = "file string, offset long, length long, payload string, side string, name string"


def replica(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def records(files: int, n: int):
    draw, rows = random.Random(1), []
    for f in range(files):
        at = 0
        for _ in range(n):
            body = "".join(draw.choice("ab") for _ in range(draw.randint(0, 40)))
            rows.append((f"f{f}", at, len(body), body))
            at += draw.choice([1, 50, 70_000, 1_000_000])
    return rows


def found(df):
    return sorted((r.file, r.offset, r.status) for r in df.collect())


def test_changed_lost_and_extra_records(spark):
    rows = records(5, 60)
    other = list(rows)
    other[3] = (*rows[3][:3], rows[3][3] + "!")
    other[250] = (rows[250][0], rows[250][1], 7, rows[250][3])
    gone, new = other.pop(100), ("f9", 0, 1, "z")
    other += [new, rows[0], rows[0]]
    want = [("f0", rows[3][1], "changed"), ("f4", rows[250][1], "changed"), (*gone[:2], "missing"), ("f9", 0, "extra")]
    assert found(warc.audit(replica(spark, rows), replica(spark, other))) == sorted(want)


def test_only_branches_that_differ_are_followed(spark):
    rows = records(20, 30)
    other = [*rows[:77], (*rows[77][:3], "other"), *rows[78:]]
    both = warc.leaves(replica(spark, rows), "left").union(warc.leaves(replica(spark, other), "right"))
    levels = warc.build(both, 6)
    for level in levels:
        sides = {}
        for r in level.collect():
            sides.setdefault((r.name, r.part), set()).add(r.digest)
        assert sum(len(s) > 1 for s in sides.values()) == 1


def test_nulls_ties_and_no_rows(spark):
    rows = [(None, None, None, None), ("a", None, 1, "x"), ("a", 0, 1, "x"), ("a", 0, 1, "y"), ("a", 5, None, None)]
    assert found(warc.audit(replica(spark, rows), replica(spark, rows * 2))) == []
    out = warc.audit(replica(spark, rows), replica(spark, rows[:3])).collect()
    assert sorted((r.file, r.offset, r.status) for r in out) == [("a", 0, "missing"), ("a", 5, "missing")]
    assert found(warc.audit(replica(spark, rows[1:2]), replica(spark, [("a", None, 1, "z")]))) == found(
        warc.audit(replica(spark, rows[1:2]), replica(spark, [("a", None, 1, "z")]))
    )
    assert found(warc.audit(replica(spark, []), replica(spark, []))) == []


def test_records_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", "é"), (2, None, None), (None, "v", "x"), (1500, "w", "y")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.page_records(pages, payload_copy=F.col("payload")).collect()}
    text = rows[1].payload_copy
    assert text.endswith("Content-Length: 2\r\n\r\né\r\n\r\n") and rows[1].length == len(text.encode())
    assert rows[1].payload_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (rows[1].offset, rows[2].offset, rows[2].file) == (0, rows[1].length, rows[1].file)
    assert rows[None].file == "pages-none.warc" and rows[1500].file == "pages-00000001.warc"
