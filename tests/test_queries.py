"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from crosscheck import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    problem = compare(spark, con, name, SF, QUERIES[name], SQL[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["pid", "uid", "split", "uid_pred", "score"]
