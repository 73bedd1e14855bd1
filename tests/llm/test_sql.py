import pytest

from spindle.llm.queries import queries
from spindle.llm.sql import oracle_sql

from ..compare import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows(spark, small, name, sf):
    assert same(spark, queries()[name], oracle_sql()[name], small.replace("sf0.001", sf)) > 0
