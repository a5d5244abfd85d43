"""Every query that has SQL gives DuckDB's rows at the smallest size."""

import math

import duckdb
import pytest

from lograft import entities, registry  # noqa: F401 (entities adds its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    r = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = [tuple(row[k] for k in order) for row in r.fetchall()]
    key = lambda row: repr(tuple(plain(v) for v in row))
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
