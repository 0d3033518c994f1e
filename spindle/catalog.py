"""Driver tables and SQL with bound parameters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from . import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables, or of all that have a contract."""
    for n in names or schemas.TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def sql(spark: SparkSession, query: str, args=None, **frames: DataFrame) -> DataFrame:
    """SQL over the frames passed by name (``{name}`` in the text), values bound by ``?`` or ``:name``.

    Values are never put into the text, and only frames that are passed can be read by name.
    """
    return spark.sql(query, args=args, **frames)


def first_row(df: DataFrame) -> Row | None:
    return df.limit(1).first()


def rows_in_chunks(df: DataFrame, size: int = 10_000) -> Iterator[list[Row]]:
    """Rows in lists of ``size``, one partition at a time on the driver."""
    chunk: list[Row] = []
    for row in df.toLocalIterator():
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def databases(spark: SparkSession, limit: int = 20) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())[:limit]


def accessible(spark: SparkSession, name: str) -> bool:
    """Whether one row of a table can be asked for."""
    try:
        spark.table(name).limit(1).collect()
    except Exception:
        return False
    return True


def jdbc(spark: SparkSession, url: str, query: str, *, fetchsize: int = 10_000, timeout: int = 300, partition: tuple | None = None, **options: str) -> DataFrame:
    """A remote query; ``partition`` is (column, lower, upper, connections) for parallel reads of a table."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetchsize).option("queryTimeout", timeout).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, n = partition
    reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.option("dbtable", f"({query}) q").load()


def plan_bytes(df: DataFrame) -> int:
    """The size of a result that the optimiser estimates from the statistics it has; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
