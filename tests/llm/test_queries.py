"""Registered corpus queries on the smallest tables, next to their SQL where they have one."""

from __future__ import annotations

import pytest

from checks.compare import connect, differences
from garoa.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS = {"op2_warc_fixity": None, "op9_leaks": None, "op6_main_text": "pages"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n != "pipeline"])
def test_query_has_a_row_for_each_of_its_table(spark, name):
    table = ROWS.get(name, "documents")
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
