"""Queries with SQL equal it; all run; __spark_entry__ names them."""

import pytest

from lattica.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    same(spark, QUERIES, ORACLE_SQL, name, sf)


def test_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert sorted(n.split("_")[0] for n in QUERIES if n != "pipeline") == sorted(f"op{i}" for i in range(1, 11))
