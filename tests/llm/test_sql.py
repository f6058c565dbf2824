"""Queries with SQL against DuckDB."""

import pytest

from sluiceway import llm

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, duck, same, name):
    same(llm.QUERIES[name](spark, SMALL).toPandas(), duck.execute(llm.ORACLES[name]).df())


def test_ten_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in llm.QUERIES) == list(range(1, 11))
