"""Queries of this subpackage against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from spindle.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in got.description)
    order = [[c[0] for c in got.description].index(n) for n in names]
    want = sorted(([r[i] for i in order] for r in got.fetchall()), key=str)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(([r[n] for n in names] for r in df.collect()), key=str) == want
