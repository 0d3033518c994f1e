"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are ordered by their concatenated random hashes, the signs of a few random
projections. A window is a stretch of that order with the same hashes (a cell), and all vectors of a
window are compared: windows of a fixed number of neighbours lose pairs where vectors crowd. There are log2(n / window) signs, rounded down, so that a cell has one or two
windows of vectors where they are spread evenly. Two vectors at the threshold share a cell with a
probability that depends on their angle alone, so the number of passes in which a linked pair shares
no cell with probability ``MISS`` at most holds for any data. Where vectors crowd together cells
grow: those of more than a block are compared in blocks, and vectors that are in a cell of more than
``CROWD`` blocks in any pass are compared with all others of that kind instead, once. Pairs that a
comparison verifies are united across passes. Equal vectors are one class from the start; a class is
known by a number of its own, so that rows which repeat an id with another vector stay apart.

A component can be larger than a cell, so its links are then counted exactly: its members are
compared in blocks, and only counts leave a block, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WINDOW, BLOCK, MISS, SEED = 512, 2048, 1e-3, 20240229
CROWD = 4
#: Blocks of this many times ``BLOCK`` vectors are compared to count a component's links.
COUNT_BLOCKS = 4


def passes_for(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """How many passes miss a pair at the threshold with probability ``miss`` at most."""
    bits = max(0.0, math.log2(max(n, 1) / window))
    p = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return 1 if p > 1 - miss else math.ceil(math.log(miss) / math.log(1 - p))


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the vectors that can be compared; null for the others."""
    for batch in batches:
        f1, f2 = [], []
        for v in batch.column(1):
            x = np.array(v.as_py() or [], np.float64) if v.is_valid else np.empty(0)
            sound = len(x) and np.isfinite(x).all() and x.any()
            h = np.frombuffer(xxhash.xxh3_128_digest((x + 0.0).tobytes()), np.int64) if sound else (None, None)
            f1.append(h[0])
            f2.append(h[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), batch.column(1)], ["vec_id", "f1", "f2", "embedding"])


def _rows(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of a list column as matrices of equal length: (positions, matrix)."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    dims = np.diff(offsets)
    found = []
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        found.append((at, flat[offsets[at][:, None] + np.arange(d)].astype(np.float64)))
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(passes: int, bits: int, seed: int):
    """The cell of each vector in each pass: its signs as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                for at, x in _rows(pa.concat_arrays([batch.column(1)])):
                    d = x.shape[1]
                    if d not in known:
                        known[d] = np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, passes * bits))
                    signs = (_unit(x) @ known[d] > 0).reshape(len(at), passes, bits)
                    cells = (signs * weights).sum(axis=2, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(batch.column(0).to_numpy()[at], passes)), pa.array(np.full(len(at) * passes, d, np.int32)), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(at))), pa.array(np.ascontiguousarray(cells.reshape(-1)))],
                        ["rep", "dim", "pass", "cell"],
                    )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        starts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            now = tuple(cols[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest position of its set) after uniting the sets of all pairs."""
    while True:
        apart = label[i] != label[j]
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def _compare(threshold: float):
    """Compares the vectors of a cell's two blocks (or one); emits links that span what it found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 5):
            rep, own, i, j = (group.column(c).to_numpy() for c in ("rep", "own", "i", "j"))
            unit = _unit(_rows(group.column("embedding").combine_chunks())[0][1])
            x = np.flatnonzero(own == i)
            y = x if i[0] == j[0] else np.flatnonzero(own == j)
            label = np.arange(len(rep))
            for lo in range(0, len(x), 256):
                rest = y[lo:] if i[0] == j[0] else y
                a, b = np.nonzero(unit[x[lo : lo + 256]] @ unit[rest].T >= threshold)
                label = _join(label, x[lo : lo + 256][a], rest[b])
            joined = np.flatnonzero(label != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[label[joined]]), pa.array(rep[joined])], ["a", "b"])

    return run


def _count(threshold: float):
    """Links of the members of a component's two blocks (or one), weighted by class size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            rep, size, own, i, j = (group.column(c).to_numpy() for c in ("rep", "size", "own", "i", "j"))
            unit = _unit(_rows(group.column("embedding").combine_chunks())[0][1])
            x = np.flatnonzero(own == i)
            y = x if i[0] == j[0] else np.flatnonzero(own == j)
            total = np.zeros(len(rep), np.int64)
            for lo in range(0, len(x), 512):
                some = x[lo : lo + 512]
                linked = unit[some] @ unit[y].T >= threshold
                linked[some[:, None] == y[None, :]] = False
                total[some] += linked @ size[y]
                if i[0] != j[0]:
                    total[y] += size[some] @ linked
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total)], ["rep", "links"])

    return run


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.9, window: int = WINDOW, block: int = BLOCK, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors`` (vec_id, embedding).

    Vectors are linked if their cosine in double precision is at least ``threshold``. Those that are
    null, empty or zero, or hold null or non-finite components, link with nothing, and vectors of
    different lengths are not linked. Rows that repeat an id are vectors of their own: each has the
    smallest id that it reaches, and rows that repeat an id and a vector are copies of each other. A
    null id is kept apart. An empty table gives no rows. Other columns are not read.
    """
    common.ship(vectors.sparkSession)
    with common.scope(vectors.sparkSession, "vectors", "vector-class-links"):
        return _near_duplicates(vectors, threshold, window, block, miss, seed)


def _near_duplicates(vectors: DataFrame, threshold: float, window: int, block: int, miss: float, seed: int) -> DataFrame:
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    printed = common.materialize(rows.mapInArrow(_print, f"vec_id long, f1 long, f2 long, embedding {kind}"), "vectors")
    classes = printed.filter("f1 is not null and vec_id is not null").groupBy("f1", "f2").agg(F.min("vec_id").alias("head"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    classes = common.materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    reps = classes.select("rep", "embedding")
    n = classes.count()
    bits = max(0, math.floor(math.log2(max(n, 1) / window)))
    passes = passes_for(n, threshold, window, miss) if bits else 1

    keyed = common.materialize(reps.mapInArrow(_project(passes, bits, seed), "rep long, dim int, pass int, cell long"), "vector-cells")
    blocks = F.ceil(F.count("*") / block).cast("int")
    large = keyed.groupBy("dim", "pass", "cell").agg(blocks.alias("nb")).filter("nb > 1")
    large = common.materialize(large, "large-cells").select(F.col("dim").alias("ld"), F.col("pass").alias("lp"), F.col("cell").alias("lc"), "nb")
    keyed = keyed.join(large, (F.col("dim") == F.col("ld")) & (F.col("pass") == F.col("lp")) & (F.col("cell") == F.col("lc")), "left")
    keyed = keyed.select("rep", "dim", "pass", "cell", F.coalesce("nb", F.lit(1)).alias("nb"))
    crowd = common.materialize(keyed.filter(F.col("nb") > CROWD).select("rep", "dim").distinct(), "vector-crowd")
    wide = crowd.groupBy("dim").agg(F.ceil(F.count("*") / (CROWD * block)).cast("int").alias("nb")).withColumnRenamed("dim", "wd")
    crowd = crowd.join(wide, F.col("dim") == F.col("wd")).select("rep", "dim", F.lit(-1).alias("pass"), F.lit(0).cast("long").alias("cell"), "nb")
    keyed = keyed.filter(F.col("nb") <= CROWD).unionByName(crowd).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    spread = keyed.select("dim", "pass", "cell", F.inline(pairs), "own", "rep")
    cells = spread.join(reps.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("dim", "pass", "cell", "i", "j", "own", "rep", "embedding")
    cells = cells.repartition("dim", "pass", "cell", "i", "j").sortWithinPartitions("dim", "pass", "cell", "i", "j", "rep")
    links = common.materialize(cells.mapInArrow(_compare(threshold), "a long, b long").distinct(), "vector-links")
    found = common.materialize(components(links), "vector-components")

    count = found.groupBy("component").agg(F.ceil(F.count("*") / (COUNT_BLOCKS * block)).cast("int").alias("nb")).withColumnRenamed("component", "c")
    members = found.join(count, F.col("component") == F.col("c")).select("component", "nb", "node")
    members = members.join(classes.select("rep", "size", "embedding"), F.col("node") == F.col("rep")).select("component", "nb", "rep", "size", "embedding")
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    tasks = members.select("component", F.inline(tasks), "own", "rep", "size", "embedding")
    tasks = tasks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")
    counts = tasks.mapInArrow(_count(threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "counted")

    heads = classes.select("f1", "f2", "rep", "head", "size")
    first = found.join(heads, F.col("node") == F.col("rep")).groupBy("component").agg(F.min("head").alias("comp")).withColumnRenamed("component", "c")
    of = heads.join(found, F.col("rep") == F.col("node"), "left").join(first, F.col("component") == F.col("c"), "left").join(counts, F.col("rep") == F.col("counted"), "left")
    of = of.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("comp", "head").alias("comp"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    of = common.materialize(of, "vector-class-links")
    out = printed.select("vec_id", "f1", "f2").join(of, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    known = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(known, F.coalesce("comp", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(common.table(spark, sf_dir, "embeddings"), threshold=0.9)


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.9),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY node),
k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT m.vec_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_links, coalesce(c.c, m.vec_id) AS component_id, coalesce(c.c, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN c ON c.node = m.vec_id LEFT JOIN k ON k.a = m.vec_id
"""
