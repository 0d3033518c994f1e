"""The pipeline against plain versions of its stages, on a small table."""

import random

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from helpers import WORD, near_groups  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from spindle.llm import common, mixing, packing, secrets, tokens, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, rows, labels = random.Random(3), [], []
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 7)))
    for i in range(400):
        words = [word() for _ in range(r.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(6):
                words.insert(r.randrange(len(words)), "idiot")
        if i % 9 == 1:
            words.insert(3, f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"')
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(0, 400, 11)]
    rows += [(2000 + i, rows[i][1] + " end", "en", "s1", 0) for i in range(3, 400, 17)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 0), (None, "no id here", "en", "s0", 0), rows[7], rows[7]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        steps[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    original = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()

    clean = {r.doc_id for r in steps["toxicity"]}
    assert clean == {r.doc_id for r in original if "idiot" not in (r.text or "")}

    groups = near_groups([(r.doc_id, r.text) for r in steps["toxicity"] if r.doc_id is not None], 5)
    kept = [r.doc_id for r in steps["minhash"] if r.doc_id is not None]
    assert sorted(kept) == sorted(i for i in clean if i is not None and groups[i] == i)
    assert sum(r.doc_id is None for r in steps["minhash"]) == 1

    model, before = secrets.field(), {r.doc_id: r.text for r in steps["minhash"]}
    for r in steps["secrets"]:
        text = before[r.doc_id]
        assert r.text == (secrets.mask(text, secrets.secret_spans(text, model)) if text else text)
    assert len(steps["secrets"]) == len(steps["minhash"]) and not any("token = " in (r.text or "") for r in steps["secrets"])

    amounts = {r.doc_id: r.taken for r in mixing.mix_amounts(spark.createDataFrame(steps["secrets"], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)).collect()}
    words = dict.fromkeys(amounts, 0)
    for r in steps["mixing"]:
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == amounts

    encoder = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json"), cut=False)
    want = sum(len(encoder.encode(r.text)) // 4 + 1 for r in steps["mixing"])
    assert sum(r.length for r in steps["packing"]) == want
    assert max(np.bincount(np.unique([r.sequence_id for r in steps["packing"]], return_inverse=True)[1], [r.length for r in steps["packing"]])) <= 4096


def test_rows_that_repeat_an_id_with_another_text(spark):
    r = random.Random(4)
    a, b, c = (" ".join("".join(r.choice("abcdeilnorst") for _ in range(6)) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (5, b), (5, c), (5, b), (7, a + " end"), (7, "a text of its own that has no twin at all"), (9, c), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.keep_one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, a), (5, b), (5, c), (7, rows[5][1]), (None, a), (None, a)]
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted(want, key=str)


def test_clashing_columns_stay(spark, sf_dir):
    names = ["toxicity", "text_hash", "kept_id", "Kept_Hash", "_rows", "_kept", "size", "spans", "component"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in pipeline.STAGES[:-1]:
        before = wide.columns
        wide = stage(spark, wide, sf_dir)
        assert wide.columns == before
    got = wide.collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names if r.doc_id is not None)


def test_run_is_the_stages_in_turn(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    got = pipeline.run(spark, sf_dir)
    assert got.columns == [f.split()[0] for f in packing.SCHEMA.split(", ")] and got.count() > 0
    assert [p.name.rsplit("-", 1)[1] for p in tmp_path.iterdir() if p.is_dir()] == ["pieces"]  # all else is deleted


def test_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.THRESHOLD == 0.3
