"""Every query that has a SQL twin gives the same rows, and is not empty."""

import pytest
from compare import connect, difference
from conftest import MEDIUM

from threadlens.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(MEDIUM)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, MEDIUM)
    assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchall()[0][0] > 0
    assert difference(df, ORACLES[name], con) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
