"""Streaming variants of batch operators."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; the checkpoint of the query remembers which were read."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """``ts`` as a timestamp in the session's zone, with rows later than ``late`` dropped by windows."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(df: DataFrame, ts: str, width: str, *keys: str, slide: str | None = None, value: str = "value") -> DataFrame:
    """Count, sum and mean of each window (and key)."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = df.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total", "mean")


def sessions(df: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    out = df.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def latest(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The newest value of each key: a snapshot of the stream, in complete or update mode."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias(ts))


def ohlc(df: DataFrame, ts: str, width: str, key: str, price: str, order: str) -> DataFrame:
    """Open, high, low, close and count of each bar."""
    at = F.struct(ts, order)
    out = df.groupBy(F.window(ts, width), key).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), key, "open", "high", "low", "close", "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Processes what is there and ends; run again, it takes only what is new."""
    return df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def to_memory(df: DataFrame, name: str, mode: str = "complete"):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def wait(query, seconds: int) -> str:
    """Waits up to ``seconds``: succeeded, failed or timeout."""
    try:
        return "succeeded" if query.awaitTermination(seconds) else "timeout"
    except Exception:
        return "failed"


#: States in which a job is over: fixed values of the interface.
TERMINAL = ("JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED")


def poll(state: Callable[[], str], timeout: float, first: float = 30.0, factor: float = 1.5, most: float = 300.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> str:
    """Asks for a job's state until it is terminal, waiting longer each time; TimeoutError after ``timeout`` seconds."""
    began, rest = clock(), first
    while (now := state()) not in TERMINAL:
        if clock() - began + rest > timeout:
            raise TimeoutError(now)
        sleep(rest)
        rest = min(most, rest * factor)
    return now


def new_only(df: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first row of each key within the time that late rows may take."""
    return event_time(df, ts, late).dropDuplicatesWithinWatermark([key])
