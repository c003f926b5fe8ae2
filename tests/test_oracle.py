import pytest

from lumastack import registry

from .oracle import compare, connection

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
ALL = registry.queries()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(ALL[name](spark, SF), con, SQL[name]) is None
