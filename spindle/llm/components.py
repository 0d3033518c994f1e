"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that ``edges`` (a, b) links to another.

    The component is the smallest node that can be reached. Each round rewires every node to the
    smallest one in its neighbourhood; the rounds needed grow with the logarithm of the diameter.
    Minima are combined before they are shuffled, and joins on a hub can be split. Each round is
    written to the shared folder, so lineage stays short. No edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = common.materialize(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).withColumnRenamed("u", "k")
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        after = common.materialize(small, "edges")
        then = _state(after)
        common.discard(spark, now)
        now, changed, state = after, then != state, then
        if not changed:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
