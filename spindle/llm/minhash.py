"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join.

A signature has 64 hashes of 16 bits, kept as 16 chunks of four (one long each). Two documents
whose signatures differ in at most ``DISTANCE`` hashes share, by the pigeonhole principle in its
general form, a chunk with at most as many errors as that chunk is allowed, if the allowances plus
one add up to ``DISTANCE + 1``: here one error in 15 chunks and none in the last. Each allowed error
is enumerated as the chunk with one hash masked, so all pairs within the distance meet in a bucket.
At a similarity of 0.8 a hash differs with probability 0.2, and more than 30 of 64 differ in fewer
than one pair in a million. Links are then confirmed on the full sets of shingles.

Equal sets are one class from the start; a class is known by a number of its own, not by a document
id, so that rows which repeat an id with another text are documents of their own. A bucket's members are compared with its smallest member
first. Members that this leaves in different components are compared with each other in blocks, but
for those with too many shingles that no other such member has: they can't be linked to any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .vectors import _groups

HASHES, CHUNKS, LANES, DISTANCE = 64, 16, 4, 30
#: Rows that say which texts to fetch are broadcast up to this number (about 64 bytes each), else joined.
BROADCAST_ROWS = 200_000
#: Members that meet one copy of a leader's text; documents and shingles of a block of a cluster.
STAR, BLOCK, BLOCK_SHINGLES = 256, 512, 400_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_draw = np.random.Generator(np.random.PCG64(20240229))
_A = _draw.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 2**63, HASHES, np.uint64)
_PLACE = _draw.integers(0, 2**63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.arange(LANES, dtype=np.uint64) * np.uint64(16)
_NIBBLES = np.arange(16, dtype=np.uint64) * np.uint64(4)


class _WordHashes(dict):
    """Hashes of words; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()
common.caches["minhash"] = _hashes.clear


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's ``k``-word shingles; fewer words are one."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    width = min(k, n)
    mixed = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        mixed += h[i : n - width + 1 + i] * _PLACE[i + (0 if n >= k else 64 * n)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """The chunks of the signature of a set as 64-bit integers, then the low nibbles of its hashes in four."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        low = np.minimum(low, (found[at : at + 4096, None] * _A + _B).min(axis=0))
    chunks = ((low & np.uint64(0xFFFF)).reshape(CHUNKS, LANES) << _SHIFTS).sum(axis=1, dtype=np.uint64)
    nibbles = ((low & np.uint64(0xF)).reshape(4, 16) << _NIBBLES).sum(axis=1, dtype=np.uint64)
    return np.concatenate([chunks, nibbles]).view(np.int64)


_CHUNK, _NIBBLE = [f"c{i}" for i in range(CHUNKS)], [f"q{i}" for i in range(4)]
_SIGNATURE = [*_CHUNK, *_NIBBLE]
_SIGNED = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, " + ", ".join(f"{c} long" for c in _SIGNATURE)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sigs = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), k)
                sizes.append(len(found))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64))
                sigs.append(signature(found))
            if sizes:
                prints, sigs = np.stack(prints), np.stack(sigs)
                columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), *(pa.array(np.ascontiguousarray(sigs[:, i])) for i in range(len(_SIGNATURE)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "f1", "f2", *_SIGNATURE])

    return run


def chunk_errors(distance: int, chunks: int = CHUNKS, lanes: int = LANES) -> list[int]:
    """Errors allowed in each chunk, -1 for one that needs no index; each plus one, they add up to distance + 1."""
    total = distance + 1
    return [min(lanes, (total + i) // chunks) - 1 for i in reversed(range(chunks))]


def _keys(distance: int) -> Column:
    """Bucket keys of a signature: each chunk with every choice of as many masked hashes as may err."""
    from itertools import combinations

    keys = []
    for i, errors in enumerate(chunk_errors(distance)):
        for masked in combinations(range(LANES), errors) if errors >= 0 else ():
            mask = (1 << 64) - 1
            for lane in masked:
                mask &= ~(0xFFFF << (16 * lane))
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.xxhash64(F.lit(len(keys)), F.col(_CHUNK[i]).bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def _differs(a: str, b: str) -> Column:
    """In how many low nibbles two signatures differ, which is never more than in how many hashes.

    Each nibble of the xor is folded to its lowest bit. The expression is short on purpose: the JVM
    doesn't compile the code of long ones, and it is evaluated for every pair that shares a bucket.
    """
    total = F.lit(0)
    for c in _NIBBLE:
        x = F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111).cast("long")))
    return total


def _fetch(wanted: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``wanted`` with the text of their ``node``, the first document of its class.

    Texts are sent where they are needed: small ``wanted`` go to the texts, large ones are joined.
    Rows of the table that repeat an id and a text come as often.
    """
    names = wanted.columns
    wanted = common.materialize(wanted.join(heads, "node").select(*names, "head", "head_hash"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return texts.join(wanted, (F.col("doc_id") == F.col("head")) & (F.col("text_hash") == F.col("head_hash"))).select(*names, "text")


def _similar(k: int, percent: int):
    """Rows (leader, copy, node, text), the leader's own first: links of the leader with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for leader, node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if leader == node:
                    if own != leader:
                        own, of = leader, shingles(text.as_py(), k)
                    continue
                found = shingles(text.as_py(), k)
                both = len(np.intersect1d(of, found, assume_unique=True))
                if 100 * both >= percent * (len(of) + len(found) - both):
                    a.append(leader)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirm(pairs: DataFrame, heads: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (leader a, member b) whose full sets are similar enough.

    A leader's text is sent once for every ``STAR`` of its members, a member's once for each leader.
    """
    pairs = common.materialize(pairs, "pairs")
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies"))
    own = copies.select(F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("a").alias("node"))
    members = pairs.join(copies.withColumnRenamed("a", "of"), F.col("a") == F.col("of")).select(F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"), F.col("b").alias("node"))
    rows = _fetch(own.unionByName(members), heads, texts)
    rows = rows.repartition("leader", "copy").sortWithinPartitions("leader", "copy", F.col("node") != F.col("leader"))
    return common.materialize(rows.mapInArrow(common.frugal(_similar(k, percent), "minhash"), "a long, b long"), "links")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select(F.col("key").alias("k"))
    return rows.join(several, F.col("key") == F.col("k")).drop("k")


def _spread(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py(), k).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int64)), pa.array(found)], ["node", "h"])

    return run


def _linkable(ids: DataFrame, heads: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the classes ``ids`` (node), those that can be similar enough to another of them.

    A shingle that only one of them has is in no intersection; a document needs enough others.
    """
    ids = common.materialize(ids, "mixed-ids")
    found = _fetch(ids, heads, texts).mapInArrow(common.frugal(_spread(k), "minhash"), "node long, h long")
    alone = found.groupBy("h").agg(F.count("*").alias("m"), F.min("node").alias("only")).filter("m = 1").groupBy("only").agg(F.count("*").alias("alone"))
    of = heads.join(ids, "node", "left_semi").join(alone, F.col("node") == F.col("only"), "left")
    return of.filter(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).select("node")


def _compare(k: int, percent: int):
    """Links between the members of a cluster's two blocks (or one); few, but they span what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            first = np.unique(group.column("node").to_numpy(), return_index=True)[1]  # rows can repeat a document
            group = group.take(pa.array(first))
            node, comp, own, i, j = (group.column(c).to_numpy() for c in ("node", "comp", "own", "i", "j"))
            sets = [shingles(t.as_py(), k) for t in group.column("text").combine_chunks()]
            size = np.array([len(x) for x in sets])
            at = np.repeat(np.arange(len(sets)), size)
            _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            several = held[column] > 1
            at, column = at[several], np.unique(column[several], return_inverse=True)[1]
            order = np.argsort(column, kind="stable")
            at, column = at[order], column[order]
            x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
            both = np.zeros((len(x), len(y)), np.float32)
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):  # the intersections, some shingles at a time
                a, b = np.searchsorted(column, (low, low + 2048))
                there = np.zeros((len(sets), 2048), np.float32)
                there[at[a:b], column[a:b] - low] = 1
                both += there[x] @ there[y].T
            linked = 100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)
            p, q = np.nonzero(linked & (comp[x][:, None] != comp[y][None, :]))
            p, q = x[p], y[q]
            label = np.unique(comp, return_inverse=True)[1]
            kept = []
            for n in range(len(p)):
                one, other = label[p[n]], label[q[n]]
                if one != other:
                    kept.append(n)
                    label[label == other] = one
            yield pa.RecordBatch.from_arrays([pa.array(node[p[kept]], pa.int64()), pa.array(node[q[kept]], pa.int64())], ["a", "b"])

    return run


def _compare_rest(rows: DataFrame, heads: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members (key, node, comp) of the same bucket in different components.

    Components that share buckets are clustered, and each cluster is compared in blocks of at most
    about ``BLOCK`` documents and ``BLOCK_SHINGLES`` shingles: a text is sent once for each block of
    its cluster, and no pairs leave a block but links that join components.
    """
    low = rows.groupBy("key").agg(F.min("comp").alias("low")).withColumnRenamed("key", "k")
    edges = rows.join(low, F.col("key") == F.col("k")).filter("comp <> low").select(F.col("low").alias("a"), F.col("comp").alias("b"))
    clusters = common.materialize(components(edges), "clusters").withColumnRenamed("node", "linked")
    members = rows.select("node", "comp").distinct().join(clusters, F.col("comp") == F.col("linked")).select("node", "comp", F.col("component").alias("cluster"))
    members = common.materialize(members.join(heads.select("node", "n"), "node"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("cluster").agg(blocks.alias("nb")).withColumnRenamed("cluster", "c")
    members = members.join(sizes, F.col("cluster") == F.col("c")).drop("c").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    tasks = _fetch(members.select("cluster", F.inline(pairs), "own", "node", "comp"), heads, texts)
    tasks = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return common.materialize(tasks.mapInArrow(common.frugal(_compare(k, percent), "minhash"), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash, component`` of each row of ``docs`` (doc_id, text).

    Words are runs without white space, A-Z in lower case. Rows are linked if the intersection of
    their sets of shingles is at least ``percent`` hundredths of the union. A null or empty text has
    no shingles and links with nothing; its ``component`` is null. Rows that repeat an id are
    documents of their own: each has the smallest id that its own text reaches. ``component`` tells
    apart components that have the same smallest id. A null id is kept apart. An empty table gives
    no rows. Other columns are not read.
    """
    common.ship(docs.sparkSession)
    with common.scope(docs.sparkSession, "signatures", "class-components"):
        return _near_duplicates(docs, shingle, percent, distance)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, distance: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = common.materialize(texts.mapInArrow(common.frugal(_sign(shingle), "minhash"), _SIGNED), "signatures")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2")
    classes = classes.agg(F.min("doc_id").alias("head"), F.min_by("text_hash", "doc_id").alias("head_hash"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in _SIGNATURE])
    classes = common.materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = classes.select("node", "head", "head_hash", "n")

    keys = classes.select("node", F.explode(_keys(distance)).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("m")).filter("m > 1").select(F.col("key").alias("bucket"), "leader")
    shared = common.materialize(keys.join(buckets, F.col("key") == F.col("bucket")).select("key", "node", "leader"), "buckets")

    sigs = classes.select("node", *_NIBBLE)
    side = lambda p: sigs.toDF(*[p + c for c in ("node", *_NIBBLE)])
    star = shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(side("x"), F.col("b") == F.col("xnode")).join(side("y"), F.col("a") == F.col("ynode"))
    star = star.filter(_differs("x", "y") <= distance).select("a", "b")
    links = _confirm(star, heads, texts, shingle, percent)
    found = common.materialize(components(links), "components").withColumnRenamed("node", "linked")

    rows = shared.join(found, F.col("node") == F.col("linked"), "left").select("key", "node", "leader", F.coalesce("component", "node").alias("comp"))
    rows = common.materialize(_mixed(common.materialize(rows, "labelled")), "mixed")
    live = common.materialize(_linkable(rows.select("node").distinct(), heads, texts, shingle, percent), "linkable")
    rows = common.materialize(_mixed(rows.join(live, "node", "left_semi")), "mixed")
    more = _compare_rest(rows.select("key", "node", "comp"), heads, texts, shingle, percent)
    if not more.isEmpty():
        found = common.materialize(components(links.unionByName(more)), "components").withColumnRenamed("node", "linked")

    first = found.join(heads, F.col("linked") == F.col("node")).groupBy("component").agg(F.min("head").alias("comp")).withColumnRenamed("component", "c")
    of = classes.select("f1", "f2", "node", "head").join(found, F.col("node") == F.col("linked"), "left").join(first, F.col("component") == F.col("c"), "left")
    of = of.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("comp", "head").alias("comp"), F.coalesce("component", "node").alias("component"))
    of = common.materialize(of, "class-components")
    out = signed.select("doc_id", "text_hash", "n_shingles", "f1", "f2").join(of, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash", "component")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash", "component")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""
