"""Every registered query of the engine against its SQL."""

import pytest
from oracle import compare, connect

from fathomdex.plans.queries import QUERIES
from fathomdex.plans.sql import SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_each_query_has_sql():
    assert QUERIES.keys() == SQL.keys() and len(QUERIES) == 44


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, SQL[name]) is None
