"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from spindle.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that SQL can't express.
WITHOUT_SQL = {"fuzzy_names", "median_regression", "smartquote_diff"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)
    return sorted(([value(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        assert _plain(rows, df.columns) == _plain(got.fetchall(), names)
    else:
        assert name in WITHOUT_SQL  # compared with plain versions in test_operators.py
        assert rows or name == "smartquote_diff"  # the smallest tables have no straight quotes


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_read_and_push_what_they_need(spark):
    plan = QUERIES["between_dates"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "NestedLoop" not in QUERIES["ccm_interval_join"](spark, SF)._jdf.queryExecution().toString()
