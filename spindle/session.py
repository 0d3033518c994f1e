"""Sessions with the settings that the library expects."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession

#: Settings that results depend on, and the adaptive execution that plans rely on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "spindle", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with ANSI SQL and adaptive execution; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): str(v) for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pool_size(env: Mapping[str, str], prefix: str = "SPINDLE_POOL", least: int = 1, most: int = 5) -> tuple[int, int]:
    """Fewest and most connections to a database, from ``<prefix>_MIN`` and ``<prefix>_MAX``: JDBC reads take one for each partition.

    Values that are no positive numbers are a ValueError, as is a range that is empty.
    """
    low, high = (int(env.get(f"{prefix}_{name}", default)) for name, default in (("MIN", least), ("MAX", most)))
    if not 1 <= low <= high:
        raise ValueError(f"{prefix}: {low} to {high} connections")
    return low, high


def healthy(spark: SparkSession) -> bool:
    """Whether the session still answers."""
    try:
        return spark.sql("select 1 as one").first().one == 1
    except Exception:
        return False


def ensured(spark: SparkSession | None, make: Callable[[], SparkSession] = session) -> SparkSession:
    """The session if it still answers, else a new one."""
    return spark if spark is not None and healthy(spark) else make()
