"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks import spark_side
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
QUERIES = {name: query for name, query in contract.queries().items() if name in ORACLES}


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


def test_every_table_query_has_an_oracle():
    assert set(spark_side.QUERIES) <= set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_oracle(spark, sql, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(found, sql.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 4
