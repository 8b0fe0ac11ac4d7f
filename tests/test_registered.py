"""Every registered query against its SQL twin, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from parleystat.plans import queries as registered
from tests.compare import database, mismatch

FOLDER = "/root/testdata/sf0.001"
QUERIES = registered.queries()
TWINS = registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    table = QUERIES[name](spark, FOLDER)
    rows = table.collect()
    assert rows
    assert mismatch(rows, table.columns, con, TWINS[name]) is None


def test_every_query_has_a_twin():
    assert set(TWINS) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(TWINS) <= set(contract.oracle_sql())


def test_entry(spark):
    table = contract.entry(spark)
    assert "coefficients" in table.columns
    assert table.count() == 22


EXPECTED = {"spec1": 108, "spec2": 106, "spec3": 85, "spec4": 85, "total_effect": 85, "path_a": 88, "full_outcome": 85}


def test_sample_sizes(spark):
    rows = QUERIES["sample_sizes"](spark, FOLDER).collect()
    assert {r["model"]: r["n"] for r in rows} == EXPECTED
