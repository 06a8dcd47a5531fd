"""Every query of the library against its oracle SQL on the smallest tables; the entry point's contract."""

import pytest

from acceptlake.plans import registry

from . import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    oracle.compare(spark, con, QUERIES[name], SQL[name], SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
