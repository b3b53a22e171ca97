"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import duckdb
import pytest

from docflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return repr(v + 0.0 if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*want.columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
