"""The SQL of the training-data queries is SQL, and gives their rows at the smallest size."""

import duckdb
import pytest

import __spark_entry__

from ..test_queries import SF, TABLES, plain

SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if k.startswith("op")}


def test_all_is_sql():
    assert all(isinstance(s, str) for s in __spark_entry__.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    r = con.execute(SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: repr([plain(v) for v in row])
    order = [names.index(c) for c in df.columns]
    assert sorted(key(x) for x in df.collect()) == sorted(key([x[k] for k in order]) for x in r.fetchall())
