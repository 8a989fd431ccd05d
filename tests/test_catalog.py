"""Every registered query of the engine against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from twigmer.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=str)
    assert got == want


def test_queries_without_sql_return_rows(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        rows = catalog.QUERIES[name](spark, DATA).collect()
        assert rows
        assert all(0 <= r.filter_value < 1 for r in rows)
