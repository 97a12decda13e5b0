"""Every query with SQL equals that SQL on the small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lattica.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return "null" if v is None or v is pd.NaT or isinstance(v, float) and v != v else repr(float(v)) if isinstance(v, float) else str(v)


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].map(plain).values.tolist()))


def same(spark, queries, sqls, name, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, expected = queries[name](spark, sf_dir).toPandas(), con.execute(sqls[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    same(spark, QUERIES, ORACLE_SQL, name, SMALL)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
