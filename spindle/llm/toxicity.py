"""Toxicity of documents: boosted trees over dense features of the text, calibrated isotonically.

Features are densities of a fixed lexicon and of a learned one (words and word beginnings that
labelled toxic documents have and others lack), how close hits stand to the second person, and
rates of capitals, punctuation and obfuscation. The learned lexicon is fitted on one half of the
sample for the features of the other, so that the trees see it as it does on new documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .boosting import Boosted, isotonic

#: The classifier is fitted on about this many labelled rows at most, drawn by a hash of their id.
SAMPLE_ROWS = 20_000
#: Beginnings of words that count as stems, beside whole words.
STEM_LENGTHS = (4, 5, 6)
MIN_SUPPORT, MIN_PURITY = 5, 0.9
THRESHOLD = 0.3

#: Insults, in English.
LEXICON = frozenset(
    "airhead bastard bitch blockhead bonehead bozo brainless buffoon clown cockroach contemptible coward creep cretin "
    "crap cunt degenerate despicable dick dimwit dipshit disgrace disgusting dolt douchebag dumb dumbass dummy dunce "
    "filth filthy fool freak fuck fucking garbage goon halfwit hate hideous horrid idiot idiotic ignoramus imbecile "
    "imbecilic incompetent inferior jackass jerk kill lame liar loathsome loser lowlife lunatic maggot moron moronic "
    "nasty nitwit numbskull oaf parasite pathetic pig prick psycho punk rat repulsive retard retarded scum scumbag "
    "scoundrel shit shitty shut simpleton slime slut sleazy stupid suck sucks swine thug tool trash twit ugly useless "
    "vermin vile whore wimp worthless wretch".split()
)
#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself yourselves ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton tes vous votre vos tú ti usted ustedes".split())
_WORDS = re.compile(r"[^\W\d_]+")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")
_RUNS = re.compile(r"[!?]{2,}")
_SYMBOLS = re.compile(r"[A-Za-z]+[@$*!013457]+[A-Za-z]+[A-Za-z@$*!013457]*")
_SPACED = re.compile(r"\b(?:[a-z][ .\-_]){3,}[a-z]\b")
_LEET = str.maketrans("@$!013457", "asioleast")
PROXIMITY = 5
NAMES = (
    "log_words lexicon_density log_lexicon learned_density log_learned learned_kinds near_you you_density capitals caps_words "
    "exclamations questions punctuation mark_runs digits symbols_in_words decoded_hits repeated_letters spaced_hits"
).split()


class _Codes(dict):
    """What a lower-case word is: 1 of the lexicon, 2 of the learned one, 3 second person, else 0."""

    def __init__(self, learned: frozenset):
        super().__init__()
        self.learned = learned

    def __missing__(self, word: str) -> int:
        if word in LEXICON or word.endswith("s") and word[:-1] in LEXICON:
            code = 1
        elif word in SECOND_PERSON:
            code = 3
        else:
            code = 2 * (word in self.learned or any(word[:n] in self.learned for n in STEM_LENGTHS if len(word) >= n))
        if len(self) >= 150_000:
            self.clear()
        self[word] = code
        return code


def features(text: str, codes: _Codes) -> list[float]:
    """The dense features of a text, in the order of ``NAMES``."""
    low = text.lower()
    words = _WORDS.findall(low)
    n, chars = max(len(words), 1), max(len(text), 1)
    marks = bytes(map(codes.__getitem__, words))
    hits, learned, you = marks.count(1), marks.count(2), marks.count(3)
    near = kinds = 0
    if hits + learned:
        at = np.frombuffer(marks, np.uint8)
        found = np.flatnonzero((at == 1) | (at == 2))
        kinds = len({words[i] for i in found.tolist() if marks[i] == 2})
        if you:
            persons = np.flatnonzero(at == 3)
            after = np.searchsorted(persons, found)
            gap = np.minimum(np.abs(persons[np.minimum(after, you - 1)] - found), np.abs(persons[np.maximum(after - 1, 0)] - found))
            near = int((gap <= PROXIMITY).sum())
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(raw, minlength=256)
    upper, digits = int(count[65:91].sum()), int(count[48:58].sum())
    marks_all = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    letters = (raw >= 65) & (raw != 0x5F)
    repeated = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & letters[2:]).sum()) if len(raw) > 2 else 0
    odd = _SYMBOLS.findall(text)
    decoded = 0
    for token in odd:
        plain = token.lower().translate(_LEET)
        decoded += codes[plain] in (1, 2) if "*" not in plain else any(len(w) == len(plain) and all(a in ("*", b) for a, b in zip(plain, w)) for w in LEXICON)
    spaced = sum(codes[re.sub(r"[ .\-_]", "", s)] in (1, 2) for s in _SPACED.findall(low))
    return [
        np.log1p(len(words)), hits / n, np.log1p(hits), learned / n, np.log1p(learned), np.log1p(kinds), near / n, you / n,
        upper / chars, len(_CAPS.findall(text)) / n, count[33] / chars, count[63] / chars, marks_all / chars, len(_RUNS.findall(text)) / n,
        digits / chars, len(odd) / n, np.log1p(decoded), repeated / chars, np.log1p(spaced),
    ]


class Model:
    """A fitted classifier; small, and sent to the executors with the function that scores."""

    def __init__(self, learned: frozenset, trees: Boosted | None, knots: tuple, base: float):
        self.learned, self.trees, self.knots, self.base = learned, trees, knots, base

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from learning: the crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each label and half a word or a beginning occurs."""
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], ["stem", "half", "toxic", "n"])

    for batch in batches:
        for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
            words = set(_WORDS.findall(text.lower()))
            counts.update((s, half, toxic) for s in words | {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n})
            if len(counts) > 200_000:
                yield flush()
                counts.clear()
    if counts:
        yield flush()


def _select(rows: list, halves: tuple) -> frozenset:
    """Stems that enough toxic documents have and nearly only those."""
    chosen = []
    for r in rows:
        t, c = sum(r[f"t{h}"] for h in halves), sum(r[f"c{h}"] for h in halves)
        if t >= (MIN_SUPPORT if len(halves) > 1 else 3) and t >= MIN_PURITY * (t + c):
            chosen.append(r["stem"])
    return frozenset(chosen)


def _featured(learned: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [_Codes(x) for x in learned]
        for batch in batches:
            rows = [features(t, codes[1 - h]) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "draw", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows that aren't held out, about ``sample_rows`` of them at most.

    Rows with a null label or id are left out; a document with several labels counts as toxic if any
    says so. Copies of a text count once, as toxic if any copy is. Without rows of both labels the
    score is the rate of label 1. All stems that the sample supports are learned; their number is
    bounded by the sample, since each needs toxic documents of its own.
    """
    common.ship(docs.sparkSession)
    with common.scope(docs.sparkSession):
        return _fit(docs, labels, sample_rows)


def _fit(docs: DataFrame, labels: DataFrame, sample_rows: int) -> Model:
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = common.text_or_empty().alias("text")
    sample = docs.select("doc_id", text).join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("text", "toxic", F.xxhash64("text").alias("h"))
    sample = sample.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("half"), F.pmod(F.xxhash64("h"), F.lit(4)).cast("int").alias("draw"))
    sample = common.materialize(sample, "labelled")

    stems = sample.select("text", "toxic", "half").mapInArrow(common.frugal(_stems), "stem string, half int, toxic int, n long")
    of = lambda toxic, half: F.sum(F.when((F.col("toxic") == toxic) & (F.col("half") == half), F.col("n")).otherwise(0))
    stems = stems.groupBy("stem").agg(of(1, 0).alias("t0"), of(1, 1).alias("t1"), of(0, 0).alias("c0"), of(0, 1).alias("c1"))
    stems = stems.filter(f"t0 + t1 >= 3 and t0 + t1 >= {MIN_PURITY} * (t0 + t1 + c0 + c1)").collect()
    learned = _select(stems, (0, 1))
    rows = sample.select("text", "toxic", "half", "draw").mapInArrow(common.frugal(_featured((_select(stems, (0,)), _select(stems, (1,))))), "toxic int, draw int, x array<double>").collect()
    y, draw = np.array([r.toxic for r in rows], float), np.array([r.draw for r in rows])
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(NAMES))
    order = np.lexsort((*x.T, y, draw)) if len(rows) else np.empty(0, int)
    x, y, draw = x[order], y[order], draw[order]
    fitted = draw != 0
    if not all(0 < y[part].sum() < part.sum() for part in (fitted, ~fitted)):
        return Model(learned, None, (), float(y.mean()) if len(y) else 0.0)
    trees = Boosted().fit(x[fitted], y[fitted])
    return Model(learned, trees, isotonic(trees.margin(x[~fitted]), y[~fitted]), float(y.mean()))


def _scored(model: Model, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(model.learned)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                x = np.array([features(t or "", codes) for t in batch.column(at).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names)

    return run


def score_documents(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text, however long; a null text counts as empty.

    Equal texts have equal scores, whatever their ids. A column of that name is replaced; all others
    stay. An empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(common.frugal(_scored(model, docs.columns.index("text"), schema.names)), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, common.table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
