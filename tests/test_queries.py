"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as registered
from check import database, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert {q for q in set(QUERIES) - set(SQL) if not re.fullmatch(r"op\d+_.*|pipeline", q)} == {
        "lsh_parameters",
        "lsh_adaptive",
        "lsh_adaptive_grouped",
        "gauss_sample",
        "approx_median",
    }


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    mine = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(mine)
    if name in SQL:
        assert difference(mine, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    assert registered.entry(spark).count() == 5000
