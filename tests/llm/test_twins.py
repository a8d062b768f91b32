"""Every query of this folder with an SQL twin, at the smallest scale; the others give their rows."""

import pytest

from graphloom.llm.queries import CATALOG
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    query, sql = CATALOG[name]
    df = query(spark, SF)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql).startswith("ok")
