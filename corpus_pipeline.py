"""A corpus pipeline of five stages, each by one of the operators in ``spindle.llm``.

Each stage takes the documents that the one before it kept, and returns the same columns, but for
the last, which returns pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import common, minhash, mixing, packing, secrets, tokens, toxicity


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels beside them, rejects go."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    score = _fresh(docs, "toxicity")
    scored = toxicity.score_documents(docs, model, score)
    return scored.filter(scored[score] < toxicity.THRESHOLD).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, once.

    Rows with the same id and different texts are different documents; rows that repeat an id and a
    text stay once, whichever of them; rows without an id all stay.
    """
    with common.scope(spark, "kept"):
        found = minhash.near_duplicates(docs, shingle=5, percent=80).filter("doc_id is not null")
        found = common.materialize(found.select("doc_id", "text_hash", "component"), "found")
        grouped = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
        keys = grouped.unionByName(found.filter("component is null").select("doc_id", "text_hash")).distinct()
        keys = common.materialize(keys.toDF("kept_id", "kept_hash"), "kept")
        repeated = found.groupBy("doc_id", "text_hash").count().filter("count > 1").join(keys, (F.col("doc_id") == F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
        repeats = not repeated.isEmpty()
    names = [_fresh(docs, n) for n in ("text_hash", "kept_id", "kept_hash")]
    hashed, keys = docs.withColumn(names[0], F.xxhash64(common.text_or_empty())), keys.toDF(*names[1:])
    out = hashed.join(keys, (F.col("doc_id").cast("long") == F.col(names[1])) & (F.col(names[0]) == F.col(names[2])), "left_semi")
    out = out.dropDuplicates(["doc_id", names[0]]) if repeats else out
    return out.unionByName(hashed.filter("doc_id is null")).drop(names[0])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in them are masked."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, with as many copies of a document as its source's target takes."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents, with their ids, in sequences of at most 4096."""
    return packing.pack_documents(docs, tokens.tokenizer_path("word_bpe_49k.json"), 2)


STAGES = [
    ("toxicity", keep_clean),
    ("minhash", keep_one_of_each),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL has neither the classifier nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again; a stage's table goes when the next one stands."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    with common.scope(spark, "pieces"):
        for name, stage in STAGES[:-1]:
            with common.scope(spark, f"stage-{name}"):
                docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            if before is not None:
                common.discard(spark, before)
            before = docs
        return STAGES[-1][1](spark, docs, sf_dir)
