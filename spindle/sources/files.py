"""Stata, SAS and Feather files as Spark data sources, and file listings.

Each file is one input partition, read by pandas or pyarrow on an executor. Files are opened by
local path, so they must lie where every executor sees them (a shared mount); Parquet, CSV, JSON and
ORC go through Spark's own readers, which reach any store.
"""

from __future__ import annotations

import glob as _glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Formats and how they are read and written; R's own format isn't.
FORMATS = {"parquet": "spark", "csv": "spark", "json": "spark", "orc": "spark", "feather": "spindle_feather", "dta": "spindle_dta", "sas7bdat": "spindle_sas"}


#: Rows that a reader holds at once.
CHUNK = 10_000


def _batches(fmt: str, path: str):
    """Record batches of a file, some rows at a time."""
    import pandas as pd
    import pyarrow as pa

    if fmt == "feather":
        with pa.memory_map(path) as source:
            reader = pa.ipc.open_file(source)
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)
        return
    if fmt == "dta":
        chunks = pd.read_stata(path, convert_categoricals=False, chunksize=CHUNK)
    else:
        chunks = pd.read_sas(path, format="sas7bdat", encoding="utf-8", chunksize=CHUNK)
    with chunks:
        for chunk in chunks:
            yield from pa.Table.from_pandas(chunk, preserve_index=False).to_batches()


def _schema(fmt: str, path: str):
    """The schema by a file's metadata, or its first rows."""
    import pyarrow as pa

    if fmt == "feather":
        with pa.memory_map(path) as source:
            return pa.ipc.open_file(source).schema
    return next(_batches(fmt, path)).schema


def value_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(label_set, code, label)`` of the value labels that a Stata file defines; data keep the codes."""
    from pandas.io.stata import StataReader

    with StataReader(path) as reader:
        rows = [(name, int(code), str(label)) for name, labels in reader.value_labels().items() for code, label in labels.items()]
    return spark.createDataFrame(rows, "label_set string, code long, label string")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, fmt: str, schema: StructType, paths: list[str]):
        self.fmt, self.schema, self.paths = fmt, schema, paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for batch in _batches(self.fmt, partition.path):
            table = pa.Table.from_batches([batch]).select(schema.names).cast(schema)
            yield from table.to_batches()


class _Writer(DataSourceWriter):
    def __init__(self, fmt: str, schema: StructType, path: str):
        self.fmt, self.names, self.path = fmt, schema.names, path

    def write(self, rows):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.feather
        from pyspark import TaskContext

        data = pd.DataFrame([tuple(r) for r in rows], columns=self.names)
        os.makedirs(self.path, exist_ok=True)
        target = f"{self.path}/part-{TaskContext.get().partitionId():05d}.{self.fmt}"
        if self.fmt == "dta":
            data.to_stata(target + ".tmp", write_index=False, version=118)
        else:
            pyarrow.feather.write_feather(pa.Table.from_pandas(data, preserve_index=False), target + ".tmp")
        os.replace(target + ".tmp", target)
        return WriterCommitMessage()


class _Source(DataSource):
    fmt = ""

    @classmethod
    def name(cls) -> str:
        return FORMATS[cls.fmt]

    def _paths(self) -> list[str]:
        path = self.options["path"]
        return sorted(_glob.glob(f"{path}/*.{self.fmt}" if os.path.isdir(path) else path))

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        schema = _schema(self.fmt, self._paths()[0])
        for i, field in enumerate(schema):
            if pa.types.is_timestamp(field.type):
                schema = schema.set(i, pa.field(field.name, pa.timestamp("us", field.type.tz)))
        return from_arrow_schema(schema)

    def reader(self, schema):
        return _Reader(self.fmt, schema, self._paths())

    def writer(self, schema, overwrite):
        return _Writer(self.fmt, schema, self.options["path"])


class Stata(_Source):
    fmt = "dta"


class Sas(_Source):
    fmt = "sas7bdat"


class Feather(_Source):
    fmt = "feather"


def register(spark: SparkSession) -> None:
    for source in (Stata, Sas, Feather):
        spark.dataSource.register(source)


def read(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None) -> DataFrame:
    """Any of ``FORMATS``; CSV and JSON need a schema."""
    how = FORMATS[fmt]
    if how != "spark":
        register(spark)
        reader = spark.read.format(how)
    else:
        if fmt in ("csv", "json") and schema is None:
            raise ValueError(f"{fmt} needs a schema")
        reader = spark.read.format(fmt).option("header", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str, **options) -> None:
    how = FORMATS[fmt]
    if how != "spark":
        register(df.sparkSession)
        df.write.format(how).mode("append").save(path)
    else:
        df.write.format(fmt).options(**({"header": True} if fmt == "csv" else {}), **options).save(path)


def listing(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """Path, length and time of the files below a folder, by suffix in any case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    wanted: Column = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") if suffixes else F.lit(True)
    return files.filter(wanted)


def fetch_lines(spark: SparkSession, path: str, target: str, pattern: str = "*.jsonl") -> None:
    """Copies the lines of all files below ``path`` whose names fit, into a folder that must not exist."""
    spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).write.text(target)


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Seeded rows of a linear model: y = 2.5 + 0.8 x1 + 1.2 x2 + 0.5 treatment + noise."""
    rows = spark.range(n).select("id", F.randn(seed).alias("x1"), F.randn(seed + 1).alias("x2"), (F.rand(seed + 2) < 0.5).cast("long").alias("treatment"), (F.randn(seed + 3) * 0.5).alias("e"))
    group = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int"))
    y = 2.5 + 0.8 * F.col("x1") + 1.2 * F.col("x2") + 0.5 * F.col("treatment") + F.col("e")
    return rows.select("id", (2015 + F.col("id") % 10).alias("year"), group.alias("group"), "x1", "x2", "treatment", y.alias("y"))
