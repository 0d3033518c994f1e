"""The registered queries on tables with planted cases: against their SQL, or against plain versions of them."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from helpers import crc
from spindle.llm import queries, tokens

WORDS = "abcdeilnorst"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice(WORDS) for _ in range(r.randint(2, 7))) for _ in range(n))
    docs, labels = [], []
    for i in range(120):
        t = text(r.randint(3, 90)) + (" you idiot" * 4 if i % 6 == 0 else "")
        if i % 10 == 3:
            t += f' token = "{hashlib.md5(str(i).encode()).hexdigest()}" AKIA{"ABCDEFGHIJKLMNOP"[: 10 + i % 6]} ' + "0123456789abcdef" * 2
        docs.append((i, t, "en", ("a", "b", None)[i % 3], len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(200 + i, docs[i][1] + " end", "en", "a", 1) for i in range(1, 60, 4)] + [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "é 中文 " * 200, "en", "b", 2), (303, text(6000), "en", "a", 1)]
    g = np.random.Generator(np.random.PCG64(3))
    base = g.standard_normal((40, 12))
    vectors = [(i, base[i].tolist(), 0) for i in range(40)] + [(100 + i, (base[i % 5] + 0.1 * g.standard_normal(12)).tolist(), 1) for i in range(60)]
    vectors += [(200, base[3].tolist(), 0), (201, (2 * base[3]).tolist(), 0), (250, base[3].tolist(), 1), (251, None, 0), (252, [0.0] * 12, 0), (253, [float("nan")] * 12, 0)]
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 40, "<p>a</p>", "é" * 40, "<p>c</p>"]
    pages = [(i, f"http://h/{i}", h) for i, h in enumerate(html)]
    turns = [(c, t, ("user", "assistant", "system")[0 if t % 2 == 0 else 1 if c % 4 else 2], text(5) + ' "q"\n') for c in range(12) for t in range(c)]
    path = str(tmp_path_factory.mktemp("planted"))
    for name, rows, kind in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("embeddings", vectors, "vec_id long, embedding array<double>, label int"),
        ("pages", pages, "page_id long, url string, html string"),
        ("conversations", turns, "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_and_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    got = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    want = sorted(([r[names.index(n)] for n in sorted(names)] for r in got.fetchall()), key=str)
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert sorted(([r[n] for n in sorted(names)] for r in rows), key=str) == want
    # the planted cases are in the result
    if name == "op2_vectors":
        assert sum(r.n_links > 0 for r in rows) > 40 and {r.vec_id: r.component_id for r in rows}[250] == 3
    if name == "op7_warc":
        assert sum(r.record_type == "revisit" for r in rows) == 4
    if name == "op6_minhash":
        assert sum(not r.kept for r in rows) >= 10
    if name == "op9_chat":
        assert {r.linked for r in rows} == {True, False}
    if name == "op10_topk":
        assert {r.query_id for r in rows} == {0, 100, 150, 200, 250}


def _texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op1(spark, sf_dir):
    whole = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json"), cut=False)
    rows = queries.QUERIES["op1_packing"](spark, sf_dir).collect()
    assert [f for f in rows[0].__fields__] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = {i: [*np.frombuffer(whole.encode(t), "<u4").tolist(), 2] for i, t in _texts(spark, sf_dir).items()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in ids.items()}
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 4096
    total = sum(r.length for r in rows)
    assert len(windows) <= -(-total // 4096) + 1


def test_op3(spark, sf_dir):
    whole, at = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"), cut=False), 0
    got = {r.doc_id: r for r in queries.QUERIES["op3_token_files"](spark, sf_dir).collect()}
    for i, t in sorted(_texts(spark, sf_dir).items()):
        ids = [*np.frombuffer(whole.encode(t), "<u4").tolist(), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op4(spark, sf_dir):
    rows = queries.QUERIES["op4_toxicity"](spark, sf_dir).collect()
    texts = _texts(spark, sf_dir)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, int("idiot" in texts[r.doc_id])) for r in rows if r.held_out]
    assert all(p for p, toxic in held if toxic) and np.mean([p == toxic for p, toxic in held]) > 0.85
    same = {}
    for r in rows:
        assert same.setdefault(texts[r.doc_id], r.score) == r.score


def test_op5(spark, sf_dir):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = _texts(spark, sf_dir)
    for r in queries.QUERIES["op5_secrets"](spark, sf_dir).collect():
        t = texts[r.doc_id]
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, _, n, _ in base) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == [s for s in said.split(",") if s]


def test_a_lookup_skips_row_groups_and_the_files_have_indexes(spark, tmp_path):
    from spindle.llm import token_files

    docs = spark.range(12_000).selectExpr("id * 2 AS doc_id", "concat('word ', id) AS text")
    path = f"{tmp_path}/tokens"
    token_files.write_token_files(docs, path, tokens.tokenizer_path("byte_bpe_50k.json"), 0, index_rows=1000)
    for doc_id, found in ((5000, 1), (5001, 0)):  # an odd id is in the range of a row group, but in no Bloom filter
        one = token_files.read_token_files(spark, path).filter(f"doc_id = {doc_id}")
        assert len(one.collect()) == found
        leaf = one._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert leaf.metrics().apply("numOutputRows").value() <= 1000 * found
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = next(str(p) for p in (tmp_path / "tokens").glob("*.orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
    said = reader.rows()
    columns = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Boolean.TYPE, 10)
    for i in range(10):
        columns[i] = True
    index = said.readRowIndex(0, columns, columns)
    assert any(b is not None for b in index.getBloomFilterIndex()) and index.getRowGroupIndex()[2].getEntryCount() > 1
    said.close()
