import os
import re

import numpy as np
import pyarrow as pa
import pytest

from helpers import crc
from spindle.llm import common, minhash, packing, token_files, tokens

SF = os.environ.get("TEST_SF_DIR_PADDING", "/root/testdata/sf0.01")
BYTE, WORDS = (tokens.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_pieces_encode_as_whole_texts(path, rows):
    cut, whole = tokens.Encoder(path), tokens.Encoder(path, cut=False)
    odd = ["a  b \n c", "It's  don't 'S x.Y, É. İstanbul x́ ́x", "<|endoftext|> hi", "... ,,", "ª, º. µm; ÿ", "\x1c\x1d a\x85b c", "A.", " "]
    for t in [r[1] or "" for r in rows] + odd:
        assert cut.encode(t) == whole.encode(t), t[:80]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_texts_encoded_together_have_the_ids_of_each(path, rows):
    """Also where white space runs, begins or ends texts, and where words carry marks or capitals."""
    r = np.random.Generator(np.random.PCG64(11))
    some = ["".join(r.choice([*" \n\t\r\x85\xa0\x1c\u2003", "  ", "\n ", " \n", "It's", "word", "Word", "NOTE", "end.", "$$$", "'", "(6)", "J\u030c", "no.,", "\u00e9t\u00e9", "12", "\u4e2d"], 30)) for _ in range(300)]
    plain = ["a word, a Word; a word.", "one\ntwo three\n", "\n\nx y", "", "x", "one\ttwo three", "word \nword", "end\n\n"]
    whole = tokens.Encoder(path, cut=False)
    for texts in (plain, [t or "" for _, t, *_ in rows], some, [""], ["", ""], []):
        for array in (pa.array(texts, pa.string()), pa.array(["left out", *texts], pa.string())[1:]):
            ids, at = tokens.Encoder(path).encode_all(array)
            assert [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] == [whole.encode(t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_a_piece_is_encoded_once_for_a_batch(path, monkeypatch):
    """Pieces that are too long for the cache too; marks and capitals take no room in it."""
    asked, ids = [], tokens.Encoder._ids
    monkeypatch.setattr(tokens.Encoder, "_ids", lambda self, piece, *a: asked.append(piece) or ids(self, piece, *a))
    encoder, long = tokens.Encoder(path), "x" * 60
    encoder.encode_all(pa.array([f"a {long} word word, word. word%%% word?!" for _ in range(50)]))
    assert sum(p.strip() == long for p in asked) == 1 and sum(p.strip().startswith("word") for p in asked) == 1
    assert not {" word,", " word.", "word,", "word."} & set(encoder)


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_pieces_met_before_are_not_asked_one_by_one(path, monkeypatch):
    """Also those with marks, capitals or a line end inside."""
    encoder, texts = tokens.Encoder(path), pa.array(["word, Word. don't (word) \u00c9t\u00e9!", "end.\nWord 12,5 word?!\n"])
    ids, _ = encoder.encode_all(texts)
    asked, missing = [], tokens.Encoder.__missing__
    monkeypatch.setattr(tokens.Encoder, "__missing__", lambda self, piece: asked.append(piece) or missing(self, piece))
    assert encoder.encode_all(texts)[0].tolist() == ids.tolist() and not asked


@pytest.mark.parametrize("path", [BYTE, WORDS])
@pytest.mark.parametrize("entries, at_once", [(5, 40), (300, 400), (1_000_000, 1 << 19)])
def test_table_changes_nothing(path, entries, at_once, monkeypatch, rows):
    """However full it is, and however long the words are; line ends stand beside anything."""
    monkeypatch.setattr(tokens, "TABLE_ENTRIES", entries)
    monkeypatch.setattr(tokens, "WORDS_BYTES", at_once)
    r = np.random.Generator(np.random.PCG64(12))
    bits = [*" \n\t\xa0\u2003\x85\x1c\0.,'!", " ", ".\n", "a\n", "\nb", ".\u00c9", "\n\u00c9", "a\nb\nc", "\u00c0\u00de\u00d7\u00f7\u00df\u00ff", "\u00aa\u00b5", "x" * 23, "y" * 24, "\u00e9" * 12, "Z" * 45, "'s", "n't", "12", "\u0130", "\u4e2d", "e\u0301"]
    some = ["".join(r.choice(bits, r.integers(1, 9))) + " " + "".join(r.choice([*"abcABC\u00e9"], 5)) for _ in range(600)]
    cut, whole = tokens.Encoder(path), tokens.Encoder(path, cut=False)
    for texts in (some[:300], [t or "" for _, t, *_ in rows], [""], [], some[300:], some[:300]):
        want = [whole.encode(t) for t in texts]
        for kind in (pa.string(), pa.large_string()):
            ids, at = cut.encode_all(pa.array([t for t in texts if not re.search(tokens._RUN.replace("z", "Z"), t)], kind))
            assert [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] == [w for t, w in zip(texts, want) if not re.search(tokens._RUN.replace("z", "Z"), t)]
    table = cut.table
    assert table.kept == table.size < entries + at_once
    assert table.find(table.pieces[: table.kept]).tolist() == list(range(table.kept))


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_ROWS", 3)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa"] * 4 + ["b" * 50] + ["", None] * 5)], ["text"])
    parts = list(tokens.slices(batch, 0))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in parts] == [2, 2, 1, 3, 3, 3, 1]


def test_workers_forget_and_give_back():
    """What one operator's tasks keep or free doesn't stay in the worker while others run."""
    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024

    def run(batches):
        for b in batches:
            held = [pa.array(np.arange(5_000)) for _ in range(5_000)]  # 200 MB in many buffers
            yield b, len(held)

    list(tokens.encoder(BYTE).encode("some words")), minhash.shingles("some words", 2)
    before = anonymous()
    assert list(common.frugal(run, "minhash")(iter([1]))) == [(1, 5_000)]
    assert not tokens._encoders and minhash._hashes
    assert anonymous() < before + 60


def test_cache_generations_change_nothing(monkeypatch, rows):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    cut, whole = tokens.Encoder(BYTE), tokens.Encoder(BYTE, cut=False)
    for t in [r[1] or "" for r in rows[:20]]:
        assert cut.encode(t) == whole.encode(t)
    assert len(cut) <= 5 and len(cut.old) <= 5


def test_token_files_round_trip(spark, docs, rows):
    path = common.new_path(spark, "t")
    token_files.write_token_files(docs, path, BYTE, 0)
    got = {r.doc_id: r for r in token_files.digest_token_files(spark, path).collect()}
    whole, at = tokens.Encoder(BYTE, cut=False), 0
    for i, t, *_ in rows:
        ids = [*np.frombuffer(whole.encode(t or ""), "<u4").tolist(), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    one = token_files.read_token_files(spark, path).filter("doc_id = 30").collect()
    assert len(one) == 1 and one[0].ids[-1] == 0


def test_token_files_odd_tables(spark, empty, repeated):
    for table, n in ((empty, 0), (repeated, 14)):
        path = common.new_path(spark, "t")
        token_files.write_token_files(table, path, BYTE, 0)
        got = token_files.digest_token_files(spark, path).collect()
        assert len(got) == n
        ends = sorted((r.start, r.n_tokens) for r in got)
        assert all(a + b == c for (a, b), (c, _) in zip(ends, ends[1:]))


def test_packing(docs, rows):
    got = packing.pack_documents(docs, WORDS, 2, block_windows=4).collect()
    whole = tokens.Encoder(WORDS, cut=False)
    for i, t, *_ in rows:
        ids = [*np.frombuffer(whole.encode(t or ""), "<u4").tolist(), 2]
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == ids
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) for p in pieces)
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
    for s in {r.sequence_id for r in got}:
        inside = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:]))
        assert sum(n for _, n in inside) <= 4096


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("parts", [1, 64, 211])
def test_padding_does_not_depend_on_the_layout(spark, parts):
    """Of all whole documents, however they are split; all ids are there once, and windows are near-equal."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(parts)
    got = packing.pack_documents(docs, WORDS, 2).select("sequence_id", "length").collect()
    _, place = np.unique([r.sequence_id for r in got], return_inverse=True)
    fill = np.bincount(place, [r.length for r in got])
    assert fill.max() <= 4096 and 1 - fill.sum() / (4096 * len(fill)) < 0.02
    assert fill.min() > 0.9 * 4096


def test_packing_odd_tables(empty, repeated):
    assert packing.pack_documents(empty, WORDS).count() == 0
    got = packing.digest_pieces(packing.pack_documents(repeated, WORDS)).collect()
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 0 for r in got) >= 2


def test_differencing_is_even_and_complete():
    sizes = np.random.Generator(np.random.PCG64(3)).integers(1, 512, 900)
    sums, window = packing.difference(sizes, 40)
    assert np.bincount(window, sizes, 40).tolist() == sums.tolist()
    assert sums.max() - sums.min() < 20
    window = packing.windows(sizes, 4096)
    assert np.bincount(window, sizes).max() <= 4096
    assert window.max() + 1 <= -(-sizes.sum() // 4096) * 1.03
    assert packing.windows(np.array([5]), 4096).tolist() == [0]
