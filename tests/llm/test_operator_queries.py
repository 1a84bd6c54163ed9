"""The operators' queries that have SQL, against it; all of them are registered."""

import pytest
from oracle import compare, connect

import __spark_entry__
from fathomdex.llm.queries import ORACLE_SQL, QUERIES


def test_registered():
    names = __spark_entry__.queries()
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(QUERIES) <= names.keys() and "pipeline" in names and len(names) == 55


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) is None
