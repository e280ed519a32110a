"""Queries of the folder against their SQL twins."""

import pytest
from compare import connect, difference
from conftest import MEDIUM

from threadlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, MEDIUM), ORACLES[name], connect(MEDIUM)) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
