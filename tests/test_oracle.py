"""Every query with an SQL twin, at the smallest scale."""

import pytest

from graphloom.catalog import registry
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]).startswith("ok")


def test_entry(spark):
    import __spark_entry__

    sizes = [r["size"] for r in __spark_entry__.entry(spark).collect()]
    assert sum(sizes) == 360 and len(sizes) < 360


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
