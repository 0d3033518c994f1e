"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_local = threading.local()

#: How to forget what a Python worker keeps from task to task, by the operator that keeps it.
caches: dict[str, Callable[[], None]] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they share a file system with the driver.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def _forget(keeps: str) -> None:
    """Empty the caches of all operators but ``keeps``."""
    for name, forget in caches.items():
        if name != keeps:
            forget()


def _give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, with little left in the worker when the task ends.

    An executor's workers wait for tasks beside its JVM and take them in turn, so what each operator
    leaves would add up in all of them. Caches of others than ``keeps`` are forgotten first.
    """

    def task(batches: Iterator) -> Iterator:
        _forget(keeps)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder is made, which only a local master can use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="spindle-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindle-{uuid.uuid4().hex}-{name}"


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table: lineage ends here.

    A lost executor costs no recomputation of what stands in the shared folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if open_scopes := getattr(_local, "scopes", None):
        open_scopes[-1].append((name, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Deletes, at its end, the tables that :func:`materialize` wrote in it.

    Of the names in ``kept``, which a result still reads, the latest table stays; a scope around
    this one takes it over. After an error nothing stays.
    """
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    written: list[tuple[str, str]] = []
    _local.scopes.append(written)
    stay: dict[str, str] = {}
    try:
        yield
        stay = {name: path for name, path in written if name in kept}
    finally:
        _local.scopes.pop()
        for _, path in written:
            if path not in stay.values():
                _delete(spark, path)
        if _local.scopes:
            _local.scopes[-1].extend(stay.items())


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[1].startswith("spindle-"):
            _delete(spark, folder)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
