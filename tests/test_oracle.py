"""Every registered query against its SQL in DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from sitegrain.catalog.oracles import ORACLES
from sitegrain.catalog.queries import QUERIES

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_all_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = queries()[name](spark, sf_dir)
    if name in ROWS_ONLY:
        assert df.count() > 0
    else:
        assert compare(df, con, oracle_sql()[name]) == ""
