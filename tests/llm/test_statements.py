"""Every operator query with a DuckDB statement, on whole tables; names of all queries."""

import pytest

import __spark_entry__ as entry
from pitlake.llm.oracles import ORACLES
from pitlake.llm.queries import QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_statement(spark, con, name):
    status, detail = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert status == "ok", (status, detail)


def test_all_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
