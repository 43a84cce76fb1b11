"""Every catalogue query against its DuckDB statement, on whole tables."""

import pytest

import __spark_entry__ as entry
from pitlake.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_statement(spark, con, name):
    status, detail = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert not status.startswith("BAD"), (status, detail)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows_and_schema(spark):
    df = entry.entry(spark)
    assert len(df.columns) == len(set(df.columns)) > 100
    assert df.limit(1).count() == 1
