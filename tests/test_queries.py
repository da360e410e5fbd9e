"""Every registered query against its SQL check, on whole tables."""

import os

import pytest

import __spark_entry__ as entry_file
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = entry_file.queries(), entry_file.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in CHECKS])
def test_agrees_with_sql(spark, con, name):
    result = compare(spark, con, SF_DIR, QUERIES[name], CHECKS[name])
    assert result["problem"] is None
    assert not result["types"]


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_recall_is_a_share(spark):
    rows = QUERIES["ann_recall_partial"](spark, SF_DIR).collect()
    assert rows and all(0 <= r["recall"] <= 1 and 0 < r["share"] for r in rows)
    assert {r["method"] for r in rows} == {"clusters", "hashed"}


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0
