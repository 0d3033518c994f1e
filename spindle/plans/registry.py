"""Named queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple = ()):
    """Registers a function of (spark, sf_dir) under its name; without SQL, rows are only counted.

    Columns in ``dates`` are returned as text on both sides, since engines hand out dates in their own types.
    """

    def add(f):
        key = f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else f
        if sql:
            replaced = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[key] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if dates else sql
        return f

    return add


def exact_sum(column: str | Column) -> Column:
    """A sum that doesn't depend on the order of rows: four decimals, as a double."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def exact_mean(column: str) -> Column:
    return F.round(exact_sum(column) / F.count(column), 6)
