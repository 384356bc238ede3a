"""Every query with a SQL twin agrees with DuckDB row by row on the smallest data."""

import pytest

from bankspark.plans import all_queries
from tests.check_queries import check, duck

QUERIES = all_queries()
EXACT = [n for n, q in QUERIES.items() if q.sql is not None]


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", EXACT)
def test_matches_sql(spark, con, folder, name):
    _, problem = check(spark, con, QUERIES[name], folder)
    assert problem == ""


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
