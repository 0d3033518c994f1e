"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

Each input partition is packed on its own as a stream of blocks, so nothing is shuffled and a
block of ``block_windows`` sequences is all that a task holds. Full windows leave a document as
they are; what remains is cut into pieces of at most ``max_piece`` ids, which differencing deals to
as many windows as their total needs. While a window comes out above the capacity, the number of
windows rises. What is left at the end of a partition, less than a block, is not packed there but
in a second pass, in which each task takes the rests of as many partitions as make several blocks.
So padding doesn't depend on how the input is split.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"

#: Blocks that a task of the second pass packs, at least.
REST_BLOCKS = 4


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal ``sizes`` to ``k`` windows of near-equal sums: (the sums, the window of each item).

    A partial partition is its k sums, descending. The two with the largest spread are merged,
    the largest sums of one with the smallest of the other, until one partition is left.
    """
    n = len(sizes)
    heap = []
    for tie, i in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        sums, groups = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], groups[0] = sizes[i], i
        heap.append((-int(sizes[i]) if k > 1 else 0, tie, sums, groups))
    heapq.heapify(heap)
    parts: list[tuple[int, int]] = []  # what group n + i is made of
    tie = n
    while len(heap) > 1:
        _, _, sums, groups = heapq.heappop(heap)
        _, _, sums2, groups2 = heapq.heappop(heap)
        sums, other = sums + sums2[::-1], groups2[::-1]
        both = np.flatnonzero((groups >= 0) & (other >= 0))
        made = np.where(groups < 0, other, groups)
        made[both] = np.arange(n + len(parts), n + len(parts) + len(both))
        parts.extend(zip(groups[both].tolist(), other[both].tolist()))
        order = np.argsort(-sums, kind="stable")
        sums, tie = sums[order], tie + 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, made[order]))
    _, _, sums, groups = heap[0]
    window = np.empty(n + len(parts), np.int64)
    window[groups[groups >= 0]] = np.flatnonzero(groups >= 0)
    for i in range(len(parts) - 1, -1, -1):
        window[list(parts[i])] = window[n + i]
    return sums, window[:n]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; the fewest windows that differencing keeps within the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sums, window = difference(sizes, k)
        if sums.max() <= capacity:
            return window
        k += max(1, int((sums.max() - capacity) * k / capacity / 2))


def _rows(pieces: list[tuple], window: np.ndarray | None, first: int = 0) -> pa.RecordBatch:
    """Pieces (doc_id, start, ids, doc_tokens) in their windows; those without windows are not placed yet."""
    order = np.arange(len(pieces)) if window is None else np.argsort(window, kind="stable")
    length = np.array([len(p[2]) // 4 for p in pieces], np.int64)[order]
    ends = np.cumsum(length)
    picked = [pieces[i] for i in order.tolist()]
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(p[2] for p in picked))])
    if window is None:
        place = [pa.nulls(len(pieces), pa.int64())] * 2
    else:
        seq = window[order]
        opens = np.flatnonzero(np.diff(seq, prepend=-1))
        offset = ends - length - np.repeat((ends - length)[opens], np.diff(opens, append=len(seq)))
        place = [pa.array(seq + first), pa.array(offset)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p in picked], pa.int64()),
            pa.array([p[1] for p in picked], pa.int64()),
            pa.array(length),
            pa.array([p[3] for p in picked], pa.int64()),
            *place,
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat),
        ],
        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def _pack(path: str, end_id: int, capacity: int, max_piece: int, block_windows: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, next_id = tokens.encoder(path), TaskContext.get().partitionId() << 33
        full: list[tuple] = []  # pieces that fill a window
        pool: list[tuple] = []
        pooled = 0
        for batch in batches:
            for some in tokens.slices(batch, 1):
                flat, ends = enc.encode_all(some.column(1))
                raw, ends = memoryview(flat).cast("B"), (4 * ends).tolist()
                for doc_id, a, b in zip(some.column(0).to_pylist(), ends[:-1], ends[1:]):
                    ids = bytes(raw[a:b]) + end
                    n = len(ids) // 4
                    whole = n - n % capacity
                    for at in range(0, whole, capacity):
                        full.append((doc_id, at, ids[4 * at : 4 * (at + capacity)], n))
                    for at in range(whole, n, max_piece):
                        pool.append((doc_id, at, ids[4 * at : 4 * min(n, at + max_piece)], n))
                    pooled += n - whole
                    if len(full) >= block_windows:
                        yield _rows(full, np.arange(len(full)), next_id)
                        next_id, full = next_id + len(full), []
                    if pooled >= block_windows * capacity:
                        window = windows(np.array([len(p[2]) // 4 for p in pool]), capacity)
                        yield _rows(pool, window, next_id)
                        next_id, pool, pooled = next_id + int(window.max()) + 1, [], 0
        if full:
            yield _rows(full, np.arange(len(full)), next_id)
            next_id += len(full)
        if pool:
            yield _rows(pool, None)

    return run


def _place(capacity: int, block_windows: int):
    """Pieces that the first pass left, in blocks; the last block is packed as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, pool, pooled = (1 << 61) + (TaskContext.get().partitionId() << 33), [], 0
        for batch in batches:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8).data
            at = (ids.offsets.to_numpy() * 4).tolist()
            for doc_id, start, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")), at[:-1], at[1:]):
                pool.append((doc_id, start, bytes(flat[a:b]), n))
                pooled += (b - a) // 4
                if pooled >= block_windows * capacity:
                    window = windows(np.array([len(p[2]) // 4 for p in pool]), capacity)
                    yield _rows(pool, window, next_id)
                    next_id, pool, pooled = next_id + int(window.max()) + 1, [], 0
        if pool:
            yield _rows(pool, windows(np.array([len(p[2]) // 4 for p in pool]), capacity), next_id)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, *, capacity: int = 4096, max_piece: int = 512, block_windows: int = 128) -> DataFrame:
    """Pieces of documents placed in sequences of at most ``capacity`` ids.

    Each row of ``docs`` is a document, also where ids repeat or are null. A null text counts as
    empty, which leaves the end id alone. Very long texts fill windows of their own. An empty
    table gives no rows. Other columns are not read. The pieces are written to the shared folder
    once, so that no text is encoded twice; a task of the second pass takes ``REST_BLOCKS`` blocks.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    pieces = common.materialize(rows.mapInArrow(common.frugal(_pack(tokenizer, end_id, capacity, max_piece, block_windows), "tokens"), SCHEMA), "pieces")
    rest = pieces.filter("sequence_id is null")
    total = rest.agg(F.sum("length").alias("n")).first().n or 0
    rest = rest.coalesce(max(1, total // (REST_BLOCKS * block_windows * capacity)))
    return pieces.filter("sequence_id is not null").unionByName(rest.mapInArrow(common.frugal(_place(capacity, block_windows)), SCHEMA))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(6)
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8).data
        at = (ids.offsets.to_numpy() * 4).tolist()
        crc = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc, *batch.columns[3:6]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def digest_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.mapInArrow(common.frugal(_crc), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return digest_pieces(pack_documents(docs, tokens.tokenizer_path("word_bpe_49k.json"), 2))
