"""Token ids as ORC files in document order.

Files hold ``(part, doc_id, local_start, n_tokens, ids)``. ORC's integer run-length encoding packs
the ids, each stripe has row indexes, and a Bloom filter on ``doc_id`` lets a lookup skip stripes.
File ``part`` holds a range of ids, ascending; ``local_start`` counts the ids before a document in
its part, so only one total for each part is needed to place any document in the whole stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: More parts than this are joined, not broadcast (16 bytes each).
BROADCAST_PARTS = 100_000


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at, part = tokens.encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for some in tokens.slices(batch, 1):
                ids, offsets = enc.encode_all(some.column(1))
                flat = pa.array(np.insert(ids, offsets[1:], np.uint32(end_id).view(np.int32)))
                offsets = offsets + np.arange(len(offsets))
                n, ends = np.diff(offsets), offsets[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), some.column(0), pa.array(at + ends - n), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, *, stripe_bytes: int = 64 << 20, index_rows: int = 1000, bloom_fpp: float = 0.01) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write ORC in ``doc_id`` order.

    A null ``doc_id`` sorts first. Repeated ids are ordered by text, and the hash of the text lets
    a hot id spread over parts. An empty table writes no rows. Other columns are not read.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
        .mapInArrow(common.frugal(_encode(tokenizer, end_id), "tokens"), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files as written. A filter on ``doc_id`` is pushed down to the stripes' metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def part_starts(files: DataFrame, name: str = "part_start") -> DataFrame:
    """A row for each part: how many ids stand in the parts before it."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias(name))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8).data
        offsets = ids.offsets.to_numpy() * 4
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets) // 4, pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the ids that the files hold."""
    common.ship(spark)
    files = read_token_files(spark, path)
    rows = files.select("part", "doc_id", "local_start", "ids").mapInArrow(common.frugal(_digest, "tokens"), "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    starts = common.materialize(part_starts(files), "parts")
    if starts.count() <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    return rows.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    write_token_files(common.table(spark, sf_dir, "documents"), path, tokens.tokenizer_path("byte_bpe_50k.json"), 0)
    return digest_token_files(spark, path)
