"""Mixing sources to target weights.

A document's key is a hash of its id and text, so the order within a source is random and the same in
every run. The key's leading bits cut each source into 1024 ranges of about equal size; their
totals, summed in order, tell in which range a source's budget ends. While that range has more than
``CUT_ROWS`` rows, the next bits cut it again. Ranges before it are taken whole, those after it not,
and only that one range is sorted to find the exact cut. Where a target exceeds what a source has, all of it is taken as often as it fits (epochs) before the cut.
No expression leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bits of the key, and how many of them each refinement reads.
KEY_BITS, STEP_BITS = 60, 10
#: The range in which a budget ends is refined until it has no more rows than this.
CUT_ROWS = 100_000
WEIGHTS = (3, 1, 2)
#: Plans of more sources than this are joined, not broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000
_SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null and empty texts have none."""
    cut = F.size(F.split(text, _SPACE + "+", -1))
    edges = text.rlike("^" + _SPACE).cast("int") + text.rlike(_SPACE + r"\z").cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(cut - edges).cast("long")


def mix_key(seed: str) -> Column:
    """60 random bits for each ``doc_id`` and ``text``; rows equal in both have the same key."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _range(shift: str | int) -> Column:
    return F.expr(f"shiftright(mix_key, {shift})")


def _end(ranges: DataFrame) -> DataFrame:
    """Of ranges (s, bucket, n, m, base, budget), the one of each source in which the budget ends."""
    order = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    return ranges.filter("before <= budget and budget < before + n").select("s", "bucket", "before", "m")


def _refine(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Ends (s, budget, bucket, before, m, shift) whose range has at most ``CUT_ROWS`` rows, or keys that are all equal."""
    spark = rows.sparkSession
    while True:
        wide = ends.filter((F.col("m") > CUT_ROWS) & (F.col("shift") > 0))
        if wide.isEmpty():
            return ends
        finer = wide.select("s", "budget", F.col("before").alias("base"), F.col("bucket").alias("of"), F.col("shift").alias("was"), F.greatest(F.col("shift") - STEP_BITS, F.lit(0)).alias("shift"))
        small = F.broadcast(finer) if finer.count() <= BROADCAST_SOURCES else finer
        inside = rows.join(small, F.col("source").eqNullSafe(F.col("s")) & (_range("was") == F.col("of")))
        ranges = inside.groupBy("s", "budget", "base", "shift", _range("shift").alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        found = finer.select(F.col("s").alias("fs"), "budget", "shift").join(_end(ranges), F.col("fs").eqNullSafe(F.col("s"))).drop("fs")
        rest = ends.filter((F.col("m") <= CUT_ROWS) | (F.col("shift") <= 0))
        ends = common.materialize(rest.unionByName(found.select(*rest.columns)), "mix-ends")


def plan_sources(rows: DataFrame, weights: tuple = WEIGHTS, ratio: float = 1.5, epochs: int = 2) -> DataFrame:
    """A row for each source: its size, target, whole epochs, and where its last epoch is cut.

    Targets share ``ratio`` times all sizes by weight, and none exceeds ``epochs`` times its source.
    What that cuts off is shared by weight again, until no target is above. With sources by rising
    cap over weight, the share of a weight that results is the largest of
    (total - caps before) / (weights from here on).
    """
    first = KEY_BITS - STEP_BITS
    buckets = rows.groupBy("source", _range(first).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
    buckets = common.materialize(buckets, "mix-buckets")
    of = buckets.groupBy("source").agg(F.sum("n").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    of = of.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    of = of.withColumn("cap", epochs * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    of = of.withColumn("share", (ratio * F.sum("source_size").over(every) - capped) / left)
    of = of.withColumn("target", F.least(F.col("cap").cast("double"), F.max("share").over(every) * F.col("weight")))
    budget, size = F.floor("target"), F.greatest("source_size", F.lit(1))
    of = of.withColumn("whole", F.floor(budget / size)).withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    of = common.materialize(of.select("source", "source_size", "target", "whole", "rest"), "mix-sources")
    ranges = buckets.withColumnRenamed("source", "s").join(of.select("source", F.col("rest").alias("budget")), F.col("s").eqNullSafe(F.col("source"))).drop("source").withColumn("base", F.lit(0).cast("long"))
    ends = of.select(F.col("source").alias("fs"), F.col("rest").alias("budget")).join(_end(ranges), F.col("fs").eqNullSafe(F.col("s"))).drop("fs")
    ends = _refine(rows, common.materialize(ends.withColumn("shift", F.lit(first)), "mix-ends")).drop("budget")
    plan = of.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select("source", "source_size", "target", "whole", "rest", F.coalesce("bucket", F.lit(-1)).alias("cut_bucket"), F.coalesce("before", F.lit(0)).alias("cut_before"), F.coalesce("shift", F.lit(first)).alias("cut_shift"))
    plan = common.materialize(plan, "mix-plan").withColumnRenamed("source", "plan_source")
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken``, the words taken of each row, repeats counted."""
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    bucket = _range("cut_shift")
    clear = rows.filter(bucket != F.col("cut_bucket"))
    clear = clear.withColumn("taken", (F.col("whole") + (bucket < F.col("cut_bucket")).cast("long")) * F.col("size"))
    order = Window.partitionBy("source").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.filter(bucket == F.col("cut_bucket"))
    before = F.col("cut_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    cut = cut.withColumn("taken", F.col("whole") * F.col("size") + part)
    return clear.unionByName(cut).drop("whole", "rest", "cut_bucket", "cut_before", "cut_shift")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("mix_key", mix_key(seed))


def mix_amounts(docs: DataFrame, *, weights: tuple = WEIGHTS, ratio: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """How many words the mix takes of each document: ``doc_id, size, source_size, target, taken``.

    A null source is a source of its own, the last; a null text has size 0. Rows that repeat an id
    or have none are documents of their own; those that agree in id and text are interchangeable.
    Very long texts are one document, cut within where a budget ends. An empty table gives no rows.
    Other columns are not read.
    """
    with common.scope(docs.sparkSession, "mix-sizes", "mix-plan"):
        return _amounts(docs, weights, ratio, epochs, seed)


def _amounts(docs: DataFrame, weights: tuple, ratio: float, epochs: int, seed: str) -> DataFrame:
    rows = sized(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), seed).drop("text")
    rows = common.materialize(rows, "mix-sizes")
    return take(rows, plan_sources(rows, weights, ratio, epochs)).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, *, weights: tuple = WEIGHTS, ratio: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies, and a cut one where a budget ends.

    Documents without words are not taken. A cut copy keeps its first words with the space before each.
    """
    names = docs.columns
    own = {c: f"_{c}" for c in ("size", "mix_key", "source_size", "target", "taken", "plan_source", "whole", "rest", "cut_bucket", "cut_before", "cut_shift", "_copy")}
    held = docs.withColumnsRenamed({k: f"_own{v}" for k, v in own.items() if k in names})
    with common.scope(docs.sparkSession, "mix-plan"):
        plan = plan_sources(common.materialize(sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-sizes"), weights, ratio, epochs)
    rows = take(sized(held, seed), plan)
    full, rest = F.expr("taken div greatest(size, 1)"), F.expr("taken % greatest(size, 1)")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_copy", F.explode(copies))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"{_SPACE}*{common.WORD}"), F.lit(0)), F.lit(1), F.col("_copy").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("_copy") > 0, first).otherwise(F.col("text")))
    rows = rows.drop(*own).withColumnsRenamed({f"_own{v}": k for k, v in own.items() if k in names})
    return rows.select(*names)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_amounts(common.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS mix_key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE))
                / CAST(sum(weight) OVER rest AS DOUBLE) AS share
      FROM w WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    rest AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(share) OVER () * weight) AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((budget // greatest(source_size, 1)) * size + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * source_size - before)) AS BIGINT) AS taken
FROM p
"""
