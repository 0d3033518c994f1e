"""Exact statistics: description, quantiles, peers, breakpoints, regressions, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


#: Accuracy of the approximate quantiles that bound an exact one: ranks are off by rows / ACCURACY at most.
ACCURACY = 2000
#: In groups of at most this many values, whose ranks are too coarse for such bounds, the extremes bound.
FEW = 20 * ACCURACY


def quantiles(df: DataFrame, by: list[str], column: str, *points: float) -> DataFrame:
    """Interpolated quantiles of each group, exact, one column for each point (``p30`` for 0.3).

    An approximate sketch, which is combined before the shuffle, bounds each quantile from both
    sides. One more pass counts the values below and those between the bounds, each distinct one, a
    small share of all, in which the exact ranks are found. So no group's
    values meet in one buffer. A group without values has null quantiles.
    """
    names = [f"p{round(p * 100)}" for p in points]
    slack = 2.0 / ACCURACY
    edges = [min(max(p + d, 0.0), 1.0) for p in points for d in (-slack, slack)]
    rows = df.select(*by, F.col(column).cast("double").alias("_x"))
    sketch = F.percentile_approx("_x", F.array(*map(F.lit, edges)), ACCURACY)
    bounds = rows.groupBy(*by).agg(F.count("_x").alias("_n"), sketch.alias("_e"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    ranges = []
    few = F.col("_n") <= FEW
    for i, p in enumerate(points):  # the outermost ranks are bounded by the extremes themselves
        low = F.when(few | F.lit(edges[2 * i] <= 0), F.col("_least")).otherwise(F.col("_e")[2 * i])
        high = F.when(few | F.lit(edges[2 * i + 1] >= 1), F.col("_most")).otherwise(F.col("_e")[2 * i + 1])
        ranges.append(F.struct(F.lit(i).alias("_i"), F.lit(p).alias("_p"), low.alias("_low"), high.alias("_high")))
    bounds = bounds.select(*[F.col(k).alias(f"_by{j}") for j, k in enumerate(by)], "_n", F.array(*ranges).alias("_ranges"))
    rows = rows.filter("_x is not null")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_by{j}")) for j, k in enumerate(by)], F.lit(True))
    met = rows.join(bounds, same) if by else rows.crossJoin(F.broadcast(bounds))  # one row
    keys = [F.col(f"_by{j}") for j in range(len(by))]
    met = met.select(*keys, "_n", "_x", F.inline("_ranges")).filter("_x <= _high")
    met = met.groupBy(*keys, "_i", F.when(F.col("_x") >= F.col("_low"), F.col("_x")).alias("_v")).agg(F.count("*").alias("_m"), F.first("_n").alias("_n"), F.first("_p").alias("_p"))
    found = met.withColumn("_to", F.sum("_m").over(Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("_p") * (F.col("_n") - 1)
    at = lambda rank: F.min(F.when(F.col("_to") > rank, F.col("_v")))
    picked = found.groupBy(*keys, "_i").agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"), F.first(place - F.floor(place)).alias("_part"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    out = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(n) for i, n in enumerate(names)])
    if not by:
        return out.select(*names)
    empty = bounds.filter("_n = 0").select(*keys, *[F.lit(None).cast("double").alias(n) for n in names])
    return out.unionByName(empty).withColumnsRenamed({f"_by{j}": k for j, k in enumerate(by)})


def median(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the exact median of each column."""
    found = [quantiles(df, [], c, 0.5).select(F.col("p50").alias(c)) for c in columns]
    return reduce(lambda a, b: a.crossJoin(b), found)  # one row each


def describe_exact(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each column: count, mean, sample deviation, minimum, quartiles, maximum, all exact."""
    columns = columns or tuple(numeric(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x")
    out = long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = out.join(quantiles(long, ["column"], "x", 0.25, 0.5, 0.75), "column", "left")
    return out.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def across(df: DataFrame, *columns: str) -> DataFrame:
    """Mean, sample deviation and non-null count of every numeric column, as ``<column>_<function>``."""
    columns = columns or tuple(numeric(df))
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("n", F.count))])


def percentile_below(peers: DataFrame, focal: float | Column, column: str) -> Column:
    """Share of peers strictly below the focal value, in percent; an aggregate of ``peers``."""
    return F.avg((F.col(column) < focal).cast("int")) * 100


def focal_vs_peers(df: DataFrame, is_focal: Column, *columns: str) -> DataFrame:
    """For each column: the focal row's value, the peers' median and mean, its percentile, % over the median."""
    rows = df.select(is_focal.alias("focal"), *[F.col(c).cast("double").alias(c) for c in columns])
    long = rows.unpivot(["focal"], list(columns), "measure", "x")
    focal = long.filter("focal").groupBy("measure").agg(F.max("x").alias("focal_value"))
    peers = long.filter("not focal").join(F.broadcast(focal), "measure")
    out = peers.groupBy("measure", "focal_value").agg(F.avg("x").alias("peer_mean"), (F.avg((F.col("x") < F.col("focal_value")).cast("int")) * 100).alias("percentile"))
    middle = quantiles(long.filter("not focal"), ["measure"], "x", 0.5).withColumnRenamed("p50", "peer_median")
    out = out.join(F.broadcast(middle), "measure")  # a row for each measure
    return out.withColumn("pct_over_median", F.try_divide(F.col("focal_value") - F.col("peer_median"), F.col("peer_median")) * 100)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls of each column, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one; nulls are equal to each other."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def content_hash(df: DataFrame) -> DataFrame:
    """A fingerprint that doesn't depend on the order of rows: the sum of their digests' first 60 bits.

    Values count as text, null as a mark of its own.
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns])
    first = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(first), F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins between minimum and maximum, which is in the last bin."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.width_bucket(F.col(column).cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double"), F.lit(bins)), F.lit(bins))
    return df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def demean(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """Columns less their group's mean (fixed effects); means are combined before the shuffle and joined back."""
    means = df.groupBy(F.col(by).alias("_by")).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    out = df.join(means, F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumns({c: F.col(c) - F.col(f"_mean_{c}") for c in columns}).select(*df.columns)


def ols(df: DataFrame, y: str, xs: list[str], intercept: bool = True, absorbed: int = 0) -> list[dict]:
    """Coefficients, standard errors, t and 95 % intervals of a least-squares fit.

    One pass sums the cross products, however many rows there are; only their matrix reaches the
    driver. ``absorbed`` counts degrees of freedom taken by fixed effects.
    """
    import numpy as np

    names = (["(intercept)"] if intercept else []) + xs
    cols = ([F.lit(1.0)] if intercept else []) + [F.col(x).cast("double") for x in xs] + [F.col(y).cast("double")]
    rows = df.dropna(subset=[y, *xs])
    products = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    got = rows.agg(F.count("*").alias("n"), *products).first()
    k = len(names)
    m = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
    inverse = np.linalg.inv(m[:k, :k])
    beta = inverse @ m[:k, k]
    rest = m[k, k] - beta @ m[:k, k]
    se = np.sqrt(np.maximum(np.diag(inverse) * rest / (got["n"] - k - absorbed), 0))
    return [{"term": n, "estimate": float(b), "std_error": float(s), "t": float(b / s) if s else float("inf"), "low": float(b - 1.96 * s), "high": float(b + 1.96 * s)} for n, b, s in zip(names, beta, se)]


def fixed_effects(df: DataFrame, by: str, y: str, xs: list[str]) -> list[dict]:
    """Within-group least squares."""
    groups = df.dropna(subset=[by, y, *xs]).select(by).distinct().count()
    return ols(demean(df.dropna(subset=[by, y, *xs]), by, y, *xs), y, xs, intercept=False, absorbed=groups)


def quantile_regression(df: DataFrame, by: str, y: str, xs: list[str], q: float = 0.5) -> DataFrame:
    """Quantile regression of each group (which must fit a task), by iteratively reweighted least squares."""
    import numpy as np
    import pandas as pd

    def fit(key, rows):
        x, v = np.column_stack([np.ones(len(rows)), rows[xs].to_numpy(float)]), rows[y].to_numpy(float)
        beta = np.linalg.lstsq(x, v, rcond=None)[0]
        for _ in range(200):
            r = v - x @ beta
            w = np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), 1e-6)
            new = np.linalg.lstsq(x * np.sqrt(w)[:, None], v * np.sqrt(w), rcond=None)[0]
            if np.abs(new - beta).max() < 1e-9:
                break
            beta = new
        return pd.DataFrame({by: key[0], "term": ["(intercept)", *xs], "estimate": beta})

    kind = df.schema[by].dataType.simpleString()
    return df.dropna(subset=[y, *xs]).groupBy(by).applyInPandas(fit, f"{by} {kind}, term string, estimate double")


def train_validation_gap(df: DataFrame, y: str, xs: list[str], seed: int, share: float = 0.8) -> dict:
    """R2 on training and validation rows of a least-squares fit, and their gap."""
    train, valid = df.dropna(subset=[y, *xs]).randomSplit([share, 1 - share], seed)
    fit = {r["term"]: r["estimate"] for r in ols(train, y, xs)}
    guess = reduce(Column.__add__, [F.col(x) * fit[x] for x in xs], F.lit(fit["(intercept)"]))
    r2 = lambda part: part.agg((1 - F.sum((F.col(y) - guess) ** 2) / (F.var_pop(y) * F.count(y))).alias("r2")).first().r2
    a, b = r2(train), r2(valid)
    return {"train": a, "validation": b, "gap": a - b}
