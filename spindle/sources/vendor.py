"""A data vendor's interface as a Spark data source, over a client that is passed in.

A client is a class, made without arguments on an executor, with
``fetch(instrument, fields, start, end, cursor) -> (rows, next cursor)``. Each instrument and range of
dates is one input partition; pages are followed to the end, with growing waits on rate limits.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.relational import date_chunks


class RateLimited(Exception):
    """The vendor asks to wait."""


def delays(attempts: int, first: float = 1.0, factor: float = 2.0, most: float = float("inf")) -> list[float]:
    """The waits between so many attempts, each ``factor`` times the one before, ``most`` at most."""
    return [min(most, first * factor**n) for n in range(attempts - 1)]


def with_backoff(call: Callable, attempts: int = 5, first: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """Calls again after a rate limit, waiting twice as long each time; other errors pass."""
    for attempt in range(attempts):
        try:
            return call()
        except RateLimited:
            if attempt == attempts - 1:
                raise
            sleep(first * 2**attempt)


def with_reconnects(call: Callable, errors: tuple = (ConnectionError, TimeoutError), attempts: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Calls again after a connection error, waiting longer by ``delay`` each time; errors of the query pass at once."""
    for attempt in range(attempts):
        try:
            return call()
        except errors:
            if attempt == attempts - 1:
                raise
            sleep(delay * (attempt + 1))


class Limiter:
    """At most ``rate`` calls a second, in one partition; total rate is that times the partitions."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = 1 / rate, clock, sleep, None

    def __call__(self) -> None:
        if self.last is not None and (rest := self.last + self.gap - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()


def pages(client, instrument: str, fields: list[str], start: str, end: str, most: int | None = None, limiter: Callable[[], None] = lambda: None, wait: float = 30.0) -> Iterator[tuple]:
    """All rows of a request, page by page, ``most`` at most."""
    cursor, n = None, 0
    while True:
        limiter()
        rows, cursor = with_backoff(lambda c=cursor: client.fetch(instrument, fields, start, end, c), first=wait)
        for row in rows:
            if most is not None and n >= most:
                return
            n += 1
            yield tuple(row)
        if cursor is None:
            return


class _Request(InputPartition):
    def __init__(self, instrument: str, start: str, end: str):
        self.instrument, self.start, self.end = instrument, start, end


class _VendorReader(DataSourceReader):
    def __init__(self, client, schema: StructType, options: dict):
        self.client, self.schema, self.options = client, schema, options

    def partitions(self):
        ranges = date_chunks(self.options["start"], self.options["end"], int(self.options.get("days", 365)))
        return [_Request(i, a, b) for i in self.options["universe"].split(",") for a, b in ranges]

    def read(self, partition):
        limiter = Limiter(float(self.options.get("rate", 10)))
        most = self.options.get("most")
        return pages(self.client(), partition.instrument, self.schema.names, partition.start, partition.end, int(most) if most else None, limiter, float(self.options.get("wait", 30)))


def history(spark: SparkSession, client: type, schema: str, universe: list[str], start: str, end: str, **options) -> DataFrame:
    """Rows of each instrument from ``start`` to ``end``, both included."""

    class Vendor(DataSource):
        @classmethod
        def name(cls) -> str:
            return "spindle_vendor"

        def reader(self, schema):
            return _VendorReader(client, schema, dict(self.options))

    spark.dataSource.register(Vendor)
    settings = {"universe": ",".join(universe), "start": start, "end": end, **{k: str(v) for k, v in options.items()}}
    return spark.read.format("spindle_vendor").schema(schema).options(**settings).load()
