import math
import random

import numpy as np
import pytest

from helpers import groups, near_groups, shingle_set
from spindle.llm import components, minhash, topk, vectors


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, k):
    want = near_groups([r[:2] for r in rows], k)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, shingle=k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {r[0]: len(shingle_set(r[1], k)) for r in rows}
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_near_duplicates_odd_tables(empty, repeated):
    assert minhash.near_duplicates(empty).count() == 0
    got = minhash.near_duplicates(repeated).collect()
    assert len(got) == 14 and all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_links_that_the_smallest_member_does_not_have(spark):
    """A chain of texts in which neighbours are similar and the ends are not."""
    words = [f"w{i}" for i in range(100)]
    texts = []
    for step in range(12):
        w = list(words)
        for j in range(step):
            w[8 * j : 8 * j + 2] = [f"n{j}", f"m{j}"]
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == near_groups(rows, 2)


def test_every_pair_within_the_distance_shares_a_bucket(spark):
    r = np.random.Generator(np.random.PCG64(1))
    assert sum(e + 1 for e in minhash.chunk_errors(30)) == 31
    base = r.integers(0, 2**16, 64, np.uint64)
    rows = []
    for n in range(40):
        sig = base.copy()
        sig[r.choice(64, 30, replace=False)] = r.integers(0, 2**16, 30, np.uint64)
        chunks = (sig.reshape(16, 4) << minhash._SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64)
        rows.append((n, *chunks.tolist()))
    chunks = (base.reshape(16, 4) << minhash._SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64)
    rows.append((99, *chunks.tolist()))
    df = spark.createDataFrame(rows, "rep long, " + ", ".join(f"{c} long" for c in minhash._CHUNK)).withColumn("keys", minhash._keys(30))
    keys = {r.rep: set(r["keys"]) for r in df.collect()}
    assert all(keys[99] & keys[n] for n in range(40))


def test_components(spark):
    r = np.random.Generator(np.random.PCG64(2))
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(900, 900 + i) for i in range(1, 50)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = sorted({i for p in pairs for i in p if p[0] != p[1]})
    assert got == groups(ids, [p for p in pairs if p[0] != p[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors():
    r = np.random.Generator(np.random.PCG64(4))
    base = r.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(40, 120):
        rows.append((i, (base[i % 7] + 0.12 * r.standard_normal(16)).tolist()))
    rows += [(200, base[3].tolist()), (201, base[3].tolist()), (202, (2 * base[3]).tolist()), (203, None), (204, []), (205, [0.0] * 16), (206, [float("nan")] + [1.0] * 15), (207, [None] + [1.0] * 15), (208, [1.0, 2.0]), (209, [1.0, 2.1]), (250, [float("inf")] * 16)]
    return rows


def _sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_near_vectors(spark):
    rows = _vectors()
    good = {i: np.array(v) for i, v in rows if _sound(v) and any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9
    linked = [(a, b) for a in good for b in good if a < b and cos(good[a], good[b])]
    want = groups([i for i, _ in rows], linked)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (2048, 16):  # components of several blocks too
        got = {r.vec_id: r for r in vectors.near_duplicate_vectors(df, window=8, block=block, miss=1e-6).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in linked) for i, _ in rows}
        assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_near_vectors_in_a_crowded_region(spark):
    """Planted pairs in a large cluster have no other links, so each must be found for itself."""
    r = np.random.Generator(np.random.PCG64(11))
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(r.standard_normal(64))
    rest = lambda n: unit((x := r.standard_normal((n, 64))) - np.outer(x @ centre, centre))
    hot = np.sqrt(0.7) * centre + np.sqrt(0.3) * rest(3000)
    off = unit((o := rest(400)) - (o * (e := unit(hot[:400] - np.sqrt(0.7) * centre))).sum(axis=1, keepdims=True) * e)
    c = (0.9001 - 0.7) / 0.3
    twins = np.sqrt(0.7) * centre + np.sqrt(0.3) * (c * e + np.sqrt(1 - c * c) * off)
    x = np.concatenate([hot, twins, r.standard_normal((6000, 64))])
    u = unit(x)
    linked = [(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(u @ u.T >= 0.9))) if a < b]
    assert {(i, 3000 + i) for i in range(400)} <= set(linked)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    for block in (2048, 64):  # cells of one block, and crowds
        got = {q.vec_id: q for q in vectors.near_duplicate_vectors(df, window=16, block=block).collect()}
        lost = [p for p in linked if got[p[0]].component_id != got[p[1]].component_id]
        assert len(lost) <= 2, (len(lost), len(linked))


def test_repeated_ids_stay_apart(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.01]), (3, [0.01, 0.99]), (3, [0.01, 0.99]), (4, [-1.0, -1.0])]
    got = sorted(tuple(r) for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)])
    r = random.Random(6)
    a, b, c = (" ".join("".join(r.choice("abcdeilnorst") for _ in range(6)) for _ in range(90)) for _ in range(3))
    docs = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, b), (1, c), (4, c + " x"), (4, c + " x"), (5, None), (5, "")]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == sorted([(1, 1)] * 3 + [(2, 1), (3, 1), (4, 1), (4, 1), (4, 1), (5, 5), (5, 5)])
    groups = {}
    for x in got:
        groups.setdefault(x.component, []).append(x.doc_id)
    assert sorted(map(sorted, groups.values())) == [[1, 2], [1, 3, 4], [1, 4, 4], [5, 5]]


def test_a_star_of_many_members_and_blocks_by_size(spark, monkeypatch):
    """Copies of a leader's text, and blocks that are cut by shingles rather than documents."""
    for name, value in (("STAR", 3), ("BLOCK", 4), ("BLOCK_SHINGLES", 300), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(8)
    base, rows = ["".join(r.choice("abcdeilnorst") for _ in range(6)) for _ in range(100)], []
    for i in range(40):
        w = list(base)
        for j in r.sample(range(100), r.randint(0, 12)):
            w[j] = "".join(r.choice("abcdeilnorst") for _ in range(6))
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == near_groups(rows, 2)


@pytest.mark.parametrize("shape", ["uniform", "clusters", "cone"])
def test_recall_of_planted_pairs(spark, shape):
    """Pairs at a cosine just above the threshold that no chain of links joins."""
    r = np.random.Generator(np.random.PCG64(12))
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(r.standard_normal((6000, 64)))
    centres = {"uniform": np.zeros((1, 64)), "clusters": unit(r.standard_normal((5, 64))), "cone": unit(r.standard_normal((1, 64)))}[shape]
    share = {"uniform": 0.0, "clusters": 0.5, "cone": 0.75}[shape]
    x = unit(np.sqrt(share) * centres[r.integers(0, len(centres), 6000)] + np.sqrt(1 - share) * x)
    off = unit((o := r.standard_normal((500, 64))) - (o * x[:500]).sum(axis=1, keepdims=True) * x[:500])
    cosine = r.uniform(0.901, 0.92, 500)[:, None]
    x = np.concatenate([x, cosine * x[:500] + np.sqrt(1 - cosine**2) * off])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {q.vec_id: q.component_id for q in vectors.near_duplicate_vectors(df, window=32, block=256).collect()}
    recall = np.mean([got[i] == got[6000 + i] for i in range(500)])
    print(shape, recall)
    assert recall >= 0.99


def test_odd_vector_tables(spark):
    kind = "label int, vec_id long, embedding array<float>, size long"
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, 5, [1.0, 0.0], 1), (1, 5, [1.0, 0.0], 1), (2, None, [1.0, 0.0], 1), (2, None, None, None)]
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 4 and [r.n_links for r in got if r.vec_id == 5] == [1, 1]


def test_passes_grow_with_the_table():
    assert vectors.passes_for(100, 0.9) == 1
    assert vectors.passes_for(50_000, 0.9) < vectors.passes_for(5_000_000, 0.9)


def test_top_k(spark):
    rows = _vectors() + [(300, [3.0] * 16), (350, [3.0] * 16), (351, [3.0] * 16), (352, [3.0] * 16)]
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if _sound(v)}
    want = {}
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q and len(x) == len(good[q]))[:5]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for pivots, block, queries, rounds in ((None, 1024, 256, None), (3, 8, 2, (1, 3))):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, pivots=pivots, block=block, queries=queries, rounds=rounds).collect()}
        assert got == want
    few = topk.top_k(df.filter("vec_id in (0, 1, 203)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1)]


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 3.0]), (2, [3.0, 3.0]), (3, [3.0, 3.0]), (4, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    one = [(1, 2, 196608), (2, 3, 196608), (3, 1, 131072), (4, 4, -65536)]
    other = [(1, 2, 196608), (2, 3, 196608), (3, 1, 0), (4, 4, -65536)]
    for block in (1, 1024):
        got = topk.top_k(df, block=block, rounds=(1,)).collect()
        assert sorted((r["rank"], r.vec_id, r.score) for r in got) == sorted(one + other)


def test_top_k_of_huge_components(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(0, [1e13, 1.0]), (1, [1.0, 2.0]), (2, [0.0, 1e13]), (3, [-3.0, 0.0])]
    good = {i: [math.floor(256 * v) for v in x] for i, x in rows}
    want = sorted(((sum(a * b for a, b in zip(good[0], good[i])), i) for i in (1, 2, 3)), reverse=True)
    got = sorted(topk.top_k(spark.createDataFrame(rows, kind)).collect(), key=lambda r: r["rank"])
    assert [(r.score, r.vec_id) for r in got] == want
    with_zero = topk.top_k(spark.createDataFrame([(0, [0.0, 1.0]), (1, [1e17, 0.0]), (2, [1.0, 1.0])], kind)).collect()
    assert sorted((r.vec_id, r.score) for r in with_zero) == [(1, 0), (2, 65536)]
    for loud in ([(0, [1e17, 0.0]), (1, [1e17, 0.0])], [(0, [1e200]), (1, [1.0])]):
        with pytest.raises(Exception, match="long|Overflow|too large|too big"):
            topk.top_k(spark.createDataFrame(loud, kind)).collect()


def test_few_annuli_are_asked_where_vectors_cluster(spark):
    r = np.random.Generator(np.random.PCG64(8))
    centres = r.standard_normal((40, 24))
    x = centres[r.integers(0, 40, 4000)] + 0.05 * r.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    counts: dict = {}
    got = {(q.query_id, q["rank"]): (q.vec_id, q.score) for q in topk.top_k(df, block=32, queries=8, counts=counts).collect()}
    whole = np.floor(256 * x).astype(int)
    for q in range(0, 4000, 50):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]
    assert counts["asked"] < 0.4 * counts["pairs"], counts
