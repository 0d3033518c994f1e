"""Exact top-k by inner product with a pivot-distance index.

One more component, sqrt(M^2 - |x|^2) with M the largest norm, makes all candidates equally long;
a query has 0 there. Then the larger the inner product, the smaller the distance, and the triangle
inequality holds: |d(q, p) - d(x, p)| <= d(q, x) for a pivot p.

Vectors are keyed by nearest pivot and distance, sorted, and cut into blocks, each an annulus
around its pivot. Queries are cut the same way. The inequality bounds from below how near a block's
vectors can be to any query of a query block. Each query block asks its nearest annuli first; their
scores give a distance beyond which nothing can be among its best, and the next round asks more
annuli, but only those whose bound lies within it. When none is left the search stops. Scores are
integers and are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Pivots are the square root of the number of vectors, within these bounds: those with the smallest hashes.
PIVOTS, PIVOT_BYTES = (16, 4096), 16 << 20
#: Vectors of a block, queries of a query block, query blocks that meet a copy of a block in one task.
BLOCK, QUERIES, ASKS = 1024, 256, 64
#: Annuli that a query block asks in the first round; each further one has eight times as many, the last all others in reach.
FIRST, FASTER = 4, 8
_INT = "vec_id long, dim int, vec binary, norm2 double"
_KEYED = "vec_id long, dim int, vec binary, pivot int, away double"
_BLOCKS = "block long, dim int, pivot int, low double, high double, ids binary, vecs binary"


def pivots_for(n: int, dim: int) -> int:
    return max(PIVOTS[0], min(PIVOTS[1], math.isqrt(n), PIVOT_BYTES // (8 * dim + 8)))


def rounds_for(blocks: int) -> tuple[int, ...]:
    """How many annuli a query block has asked after each round but the last."""
    steps = [FIRST]
    while steps[-1] * FASTER <= blocks // 2:
        steps.append(steps[-1] * FASTER)
    return tuple(steps)


def _integers(scale: float):
    """Vectors of whole numbers; those that are null, empty or hold null or non-finite components go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.array(v.as_py() or [], np.float64) if v.is_valid else np.empty(0)
                if len(x) and np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        y = np.floor(scale * x) + 0.0
                        norm2 = float((y * y).sum())
                    if not norm2 < 1e300:
                        raise OverflowError(f"vector {i}: scores don't fit a long")
                    rows.append((i, len(x), y.astype("<f8").tobytes(), norm2))
            names = ["vec_id", "dim", "vec", "norm2"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.float64()))], names)

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _lift(x: np.ndarray, norm2: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - norm2, 0))[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T, 0))


def _nearest(pivots: dict, most: dict, asking: bool):
    """The nearest pivot of each vector, as a candidate or as a query, and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                dims = batch.column(1).to_numpy()
                for d in np.unique(dims).tolist():
                    some = batch.filter(pa.array(dims == d))
                    norm2 = some.column(3).to_numpy()
                    x = _lift(_matrix(some.column(2)), norm2, norm2.max() if asking else most[d])
                    if asking:
                        x[:, -1] = 0
                    away = _distances(x, pivots[d])
                    near = away.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], ["vec_id", "dim", "vec", "pivot", "away"])

    return run


def _cut(block: int):
    """Sorted vectors to blocks of one pivot; a vector that repeats with its id counts once."""
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def row(key):
            columns = ([next_id], [key[0]], [key[1]], [held[0][2]], [held[-1][2]], [np.array([h[0] for h in held], "<i8").tobytes()], [b"".join(h[1] for h in held)])
            types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        key = last = None
        for batch in batches:
            for i, d, v, p, a in zip(*(c.to_pylist() for c in batch.columns)):
                if last == (i, v):
                    continue
                last = (i, v)
                if held and (key != (d, p) or len(held) == block):
                    yield row(key)
                    next_id, held = next_id + 1, []
                key = (d, p)
                held.append((i, v, a))
        if held:
            yield row(key)

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by floating point, long or unbounded integers, as they need."""
    bound = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2**63 and max(np.abs(q).max(), np.abs(x).max()) < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], object)
    return whole(q) @ whole(x).T


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, taus: list):
    """For each query its k best vectors of other ids, ties to smaller ids, none below its tau: (scores, ids)."""
    order = np.argsort(ids, kind="stable")
    ids, score = ids[order], _products(q, x)[:, order]
    for row, own, tau in zip(score, query_ids, taus):
        there = np.flatnonzero((ids != own) & (row >= tau) if tau is not None else ids != own)
        if len(there) > k:
            least = np.partition(row[there], len(there) - k)[len(there) - k]
            there = there[row[there] >= least]
        there = there[np.argsort(-row[there], kind="stable")][:k]
        yield row[there], ids[there]


def _reach(pivots: dict):
    """For each query block and pivot, the least and the largest distance of its queries from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, d, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1, 6))):
                q = np.frombuffer(raw, "<f8").reshape(-1, d)
                away = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots[d])
                n = away.shape[1]
                columns = [np.full(n, b, np.int64), np.full(n, d, np.int32), np.arange(n, dtype=np.int32), away.min(axis=0), away.max(axis=0)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["qb", "qdim", "qpivot", "least", "most"])

    return run


def _spans(most: dict):
    """For each query its place in its block and |q|^2 + M^2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, d, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1, 6))):
                q = np.frombuffer(raw, "<f8").reshape(-1, d)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), b)), pa.array(np.arange(len(q), dtype=np.int32)), pa.array((q * q).sum(axis=1) + most[d])], ["qb", "place", "span"])

    return run


def _ask(k: int):
    """Rows of a block's copy: first its vectors, then the query blocks that ask it."""
    names = ["qb", "place", "query_id", "score", "vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = None
        for batch in batches:
            for qb, raw_ids, raw, taus in zip(*(batch.column(c).to_pylist() for c in ("qb", "ids", "vecs", "taus"))):
                some = np.frombuffer(raw_ids, "<i8")
                vectors = np.frombuffer(raw, "<f8").reshape(len(some), -1)
                if qb is None:
                    ids, x = some, vectors
                    continue
                of = {t["place"]: t["tau"] for t in taus or ()}
                found = _best(some, vectors, ids, x, k, [of.get(i) for i in range(len(some))])
                out = [(qb, n, int(i), int(s), c) for n, (i, (scores, best)) in enumerate(zip(some, found)) for s, c in zip(scores.tolist(), best.tolist())]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: float = 256.0, pivots: int | None = None, block: int = BLOCK, queries: int = QUERIES, rounds: tuple | None = None, counts: dict | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of all other vectors for each query.

    Components x count as floor(scale * x). Queries are the rows whose vec_id is divisible by
    ``every``; candidates are all rows but those with the query's id, and of its length. Ties go to
    the smaller vec_id; with fewer than k candidates, all are returned. Vectors (or ids) that are
    null, or that hold null or non-finite components, take no part. Rows that repeat an id and a
    vector count once; an id with several vectors is as many queries, each with its own ranks, and
    as many candidates. A score that doesn't fit a long is an error. An empty table gives no rows.
    Other columns are not read. ``counts`` is filled with how many pairs of query and vector block
    there are and how many were asked.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    with common.scope(spark, "topk-best"):
        return _search(spark, vectors, k, every, scale, pivots, block, queries, rounds, counts)


def _search(spark: SparkSession, vectors: DataFrame, k: int, every: int, scale: float, pivots: int | None, block: int, queries: int, rounds: tuple | None, counts: dict | None) -> DataFrame:
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = common.materialize(rows.mapInArrow(_integers(scale), _INT), "integers")
    sizes = whole.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("m")).collect()  # a row for each length
    most, wanted = {r.dim: r.m for r in sizes}, {r.dim: pivots or pivots_for(r.n, r.dim) for r in sizes}
    drawn = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", "vec")))
    sample: dict = {}
    for r in whole.withColumn("drawn", drawn).filter(F.col("drawn") <= max(wanted.values(), default=0)).collect():
        if r.drawn <= wanted[r.dim]:
            sample.setdefault(r.dim, []).append((r.drawn, r.vec, r.norm2))
    chosen = {d: _lift(np.stack([np.frombuffer(v, "<f8") for _, v, _ in sorted(x)]), np.array([n for _, _, n in sorted(x)]), most[d]) for d, x in sample.items()}

    order = ("dim", "pivot", "away", "vec_id")

    def blocked(some: DataFrame, asking: bool, size: int, name: str) -> DataFrame:
        keyed = some.mapInArrow(_nearest(chosen, most, asking), _KEYED).repartitionByRange(*order).sortWithinPartitions(*order, "vec")
        return common.materialize(keyed.mapInArrow(_cut(size), _BLOCKS), name)

    blocks = blocked(whole, False, block, "topk-blocks")
    asking = blocked(whole.filter(F.col("vec_id") % every == 0), True, queries, "topk-queries")
    reach = asking.mapInArrow(_reach(chosen), "qb long, qdim int, qpivot int, least double, most double")
    annuli = blocks.select("block", "dim", "pivot", "low", "high")
    pairs = reach.join(annuli, (F.col("qdim") == F.col("dim")) & (F.col("qpivot") == F.col("pivot")))
    bound = F.greatest(F.lit(0.0), F.col("least") - F.col("high"), F.col("low") - F.col("most"))
    middle = F.col("least") + F.col("most") + F.col("low") + F.col("high")
    nth = F.row_number().over(Window.partitionBy("qb").orderBy("bound", "middle", "block"))
    pairs = common.materialize(pairs.select("qb", "block", bound.alias("bound"), middle.alias("middle")).withColumn("nth", nth).drop("middle"), "topk-pairs")

    spans = asking.mapInArrow(_spans(most), "qb long, place int, span double")
    kind = "array<struct<place:int,tau:long>>"
    best, asked = spark.createDataFrame([], "qb long, place int, query_id long, score long, vec_id long"), 0
    steps = [0, *(rounds or rounds_for(blocks.count())), None]
    for low, high in zip(steps, steps[1:]):
        now = pairs.filter(F.col("nth") > low)
        now = now.filter(F.col("nth") <= high) if high else now
        if low:
            taus = best.groupBy("qb", "place").agg(F.count("*").alias("n"), F.min("score").alias("tau")).filter(F.col("n") == k).drop("n")
            far = F.sqrt(F.greatest(F.col("span") - 2.0 * F.col("tau"), F.lit(0.0))) + 1e-6 * (1 + F.sqrt("span"))  # rounding must not exclude a block
            known = spans.join(taus, ["qb", "place"], "left").groupBy(F.col("qb").alias("kq")).agg(
                F.max(F.when(F.col("tau").isNull(), F.lit(float("inf"))).otherwise(far)).alias("radius"), F.collect_list(F.when(F.col("tau").isNotNull(), F.struct("place", "tau"))).alias("taus")
            )
            known = common.materialize(known, "topk-radius")
            now = now.join(known.select("kq", "radius"), F.col("qb") == F.col("kq")).filter("bound <= radius")
        else:
            known = asking.select(F.col("block").alias("kq"), F.lit(None).cast(kind).alias("taus"))
        now = common.materialize(now.select("qb", "block"), "topk-asks")
        if low and now.isEmpty():  # bounds rise with nth, so that none is left
            break
        if counts is not None:
            asked += now.count()
        copies = now.groupBy("block").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("copies")).withColumnRenamed("block", "b")
        sent = now.join(copies, F.col("block") == F.col("b")).select("qb", "block", F.pmod(F.xxhash64("qb"), F.col("copies")).cast("int").alias("copy"))
        held = asking.select(F.col("block").alias("aq"), "ids", "vecs").join(known, F.col("aq") == F.col("kq"))
        sent = sent.join(held, F.col("qb") == F.col("aq")).select("block", "copy", "qb", "ids", "vecs", "taus")
        there = blocks.select("block", "ids", "vecs").join(copies, F.col("block") == F.col("b"))
        there = there.select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("qb"), "ids", "vecs", F.lit(None).cast(kind).alias("taus"))
        met = there.unionByName(sent).repartition("block", "copy").sortWithinPartitions("block", "copy", F.col("qb").asc_nulls_first())
        found = met.mapInArrow(_ask(k), "qb long, place int, query_id long, score long, vec_id long")
        rank = F.row_number().over(Window.partitionBy("qb", "place").orderBy(F.col("score").desc(), "vec_id"))
        best = common.materialize((best.unionByName(found) if low else found).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k), "topk-best").drop("rank")
    if counts is not None:
        counts |= {"pairs": pairs.count(), "asked": asked}
    rank = F.row_number().over(Window.partitionBy("qb", "place").orderBy(F.col("score").desc(), "vec_id"))
    return best.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(256 * e)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
