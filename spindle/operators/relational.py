"""Relational operators that need an explicit order, an interval, or a policy.

DataFrames have no row order, so every operator whose result depends on one takes it as an argument.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in ([keys] if isinstance(keys, (str, Column)) else keys)]


def dedupe_keep(df: DataFrame, keys, order_by, keep: str = "last") -> DataFrame:
    """One row for each key: the first or last by ``order_by``, which must be given."""
    if not order_by:
        raise ValueError("which row to keep needs an order")
    order = [c.asc_nulls_first() if keep == "first" else c.desc_nulls_last() for c in _cols(order_by)]
    rank = F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys, at: str, *values: str) -> DataFrame:
    """The values on the latest date of each key; combined before the shuffle, no sort."""
    newest = F.max(F.struct(F.col(at), *[F.col(v) for v in values])).alias("_newest")
    return df.groupBy(*_cols(keys)).agg(newest).select(*[F.col(k) for k in ([keys] if isinstance(keys, str) else keys)], "_newest.*")


def interval_join(left: DataFrame, right: DataFrame, on: Iterable[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Rows of ``right`` whose closed interval holds ``left.at``; a null end is open.

    The equal keys keep it a hash or merge join, and the interval is checked inside it.
    """
    on = list(on)
    if not on:
        raise ValueError("without an equal key use range_join")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    equal = [F.col(k) == F.col(f"_r_{k}") for k in on]
    held = (F.col(at) >= F.col(start)) & (F.col(at) <= F.coalesce(F.col(end), F.lit(FOREVER).cast("date")))
    return left.join(renamed, reduce(Column.__and__, equal) & held, how).drop(*[f"_r_{k}" for k in on])


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """Points (dates) inside closed ranges, without an equal key: both meet in bins of ``width`` days, then are checked.

    Without a width it is the mean length of the ranges, so that a range lies in about two bins.
    """
    if width is None:
        mean = ranges.agg(F.avg(F.date_diff(F.col(end), F.col(start)) + 1).alias("days")).first().days
        width = max(1, round(mean or 1))
    bin_of = lambda c: F.floor(F.unix_date(F.col(c)) / width)
    spread = ranges.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    held = (F.col("_at_bin") == F.col("_bin")) & F.col(at).between(F.col(start), F.col(end))
    return points.withColumn("_at_bin", bin_of(at)).join(spread, held).drop("_bin", "_at_bin")


def pair_counts(df: DataFrame, item: str, group: str, most: int = 1000) -> DataFrame:
    """``(a, b, shared)``: in how many groups two items occur together, for all pairs with a < b.

    A group of more than ``most`` items is spread: one side is dealt over as many parts as it has
    multiples of ``most``, the other is sent to each, so that no task pairs a whole large group.
    """
    held = df.select(F.col(group).alias("_g"), F.col(item).alias("a")).distinct()
    large = df.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).filter("_parts > 1")
    if large.isEmpty():
        right = held.select(F.col("_g").alias("_h"), F.col("a").alias("b"))
        met = held.join(right, (F.col("_g") == F.col("_h")) & (F.col("a") < F.col("b")))
        return met.groupBy("a", "b").agg(F.count("*").alias("shared"))
    held = held.join(large, "_g", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    left = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    right = held.select(F.col("_g").alias("_h"), F.col("a").alias("b"), F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int").alias("_own"))
    met = left.join(right, (F.col("_g") == F.col("_h")) & (F.col("_part") == F.col("_own")) & (F.col("a") < F.col("b")))
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def collapse_ranges(df: DataFrame, keys, start: str, end: str, mode: str = "islands") -> DataFrame:
    """Ranges that overlap or abut (by a day), joined.

    ``islands`` starts a new range after each gap. ``reference`` gives every joined range the first
    start of its key and keeps the last row of each start, gaps notwithstanding.
    """
    order = Window.partitionBy(*_cols(keys)).orderBy(start, end)
    if mode == "reference":
        before = F.lag(end).over(order)
        first = F.first(start, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        joined = df.withColumn("_start", F.when(F.col(start) == F.date_add(before, 1), first).otherwise(F.col(start)))
        last = joined.withColumn(start, F.col("_start")).drop("_start")
        return dedupe_keep(last, [*_cols(keys), F.col(start)], end, "last")
    if mode != "islands":
        raise ValueError(mode)
    reach = F.max(F.coalesce(F.col(end), F.lit(FOREVER).cast("date"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > F.date_add(reach, 1)).cast("int"), F.lit(1))
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    stop = F.max(F.coalesce(F.col(end), F.lit(FOREVER).cast("date")))
    out = marked.groupBy(*_cols(keys), "_island").agg(F.min(start).alias(start), F.nullif(stop, F.lit(FOREVER).cast("date")).alias(end))
    return out.drop("_island")


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of all frames, with the frame's name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(tag, F.lit(n)) for n, f in frames.items()])


def last_wins(frames: Iterable[DataFrame], keys) -> DataFrame:
    """Union in which, for each key, the row of the last frame that has it stays."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_turn", F.lit(i)) for i, f in enumerate(frames)])
    return dedupe_keep(tagged, keys, "_turn", "last").drop("_turn")


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the condition holds, and all others (also where it is null)."""
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(holds), df.filter(~holds)


def all_of(conditions: Iterable[Column | None]) -> Column:
    """The conditions that are given, joined by and; true if there is none."""
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def top_n(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` largest; equal ones by the columns of ``ties``."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def sample_exact(df: DataFrame, n: int, seed: int, key: str | None = None) -> DataFrame:
    """``n`` random rows; by a digest of ``key``, if one is given, the same rows in every run and engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))) if key else F.rand(seed)).limit(n)


def preview(df: DataFrame, n: int, *order) -> DataFrame:
    """The first and last ``n`` rows in the given order, marked ``head`` and ``tail``."""
    columns = _cols(order)
    tail = df.orderBy(*[c.desc_nulls_last() for c in columns]).limit(n).withColumn("part", F.lit("tail"))
    return df.orderBy(*[c.asc_nulls_first() for c in columns]).limit(n).withColumn("part", F.lit("head")).unionByName(tail)


def snake_case(df: DataFrame) -> DataFrame:
    """All columns in lower case with underscores; ValueError if two become one."""
    import re

    names = [re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower()).strip("_") for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns clash: {names}")
    return df.toDF(*names)


def any_name(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Rows whose column holds, in any case, one of the names whole or its first word.

    A first word is looked up among the column's words where it is one; ``names`` is a small list
    of inputs, and all patterns are tested against a value at once.
    """
    wanted = names.select(F.lower(F.trim(name)).alias("_n")).filter("_n <> ''")
    wanted = wanted.select(F.explode(F.array("_n", F.element_at(F.split("_n", r"\s+"), 1))).alias("_n")).agg(F.collect_set("_n").alias("_names"))
    return df.crossJoin(F.broadcast(wanted)).filter(F.exists("_names", lambda x: F.contains(F.lower(column), x))).drop("_names")


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """Page ``number`` (from 0) in the given order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def numbered(df: DataFrame, order: str, *ties: str, name: str = "number", ranges: int = 200) -> DataFrame:
    """Rows numbered from 0 by a column of numbers, dates or times, nulls first.

    Approximate quantiles cut the column into ranges; numbers run inside a range and start after the
    rows of the ranges before, so that no task sorts the whole table. Rows that agree in the column
    are in one range, by ``ties``.
    """
    place = F.col(order).cast("double") if dict(df.dtypes)[order] != "date" else F.unix_date(order).cast("double")
    if dict(df.dtypes)[order].startswith("timestamp"):
        place = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    cuts = df.agg(F.percentile_approx(place, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    marked = df.withColumn("_place", place)
    bucket = F.when(F.col("_place").isNull(), -1).otherwise(F.size(F.filter(F.lit(cuts).cast("array<double>") if cuts else F.array().cast("array<double>"), lambda c: c < F.col("_place"))))
    marked = marked.withColumn("_range", bucket).drop("_place")
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = marked.groupBy("_range").agg(F.count("*").alias("_rows")).select(F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order, *ties)) - 1
    out = marked.withColumn("_own", own).join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_of", "_before", "_own")


def chunked(df: DataFrame, order: str, size: int, *ties: str, name: str = "chunk") -> DataFrame:
    """Which chunk of ``size`` rows each row is in, in the order of a column."""
    return numbered(df, order, *ties, name="_number").withColumn(name, F.floor(F.col("_number") / size)).drop("_number")


def date_chunks(start: str, end: str, days: int) -> list[tuple[str, str]]:
    """Closed ranges of ``days`` that cover start to end, the last day included."""
    from datetime import date, timedelta

    at, last, out = date.fromisoformat(start), date.fromisoformat(end), []
    while at <= last:
        stop = min(at + timedelta(days - 1), last)
        out.append((at.isoformat(), stop.isoformat()))
        at = stop + timedelta(1)
    return out


def wide(df: DataFrame, key, column: str, value: str, values: list) -> DataFrame:
    """A column for each of ``values``; naming them spares a job that looks for them."""
    return df.groupBy(*_cols(key)).pivot(column, values).agg(F.first(value))


class FilterPolicy:
    """Predicates that every query of a dataset must declare."""

    def __init__(self, **required: str):
        self.required = required

    def check(self, declared: Mapping[str, str]) -> None:
        missing = [f"{k} = {v!r}" for k, v in self.required.items() if declared.get(k) != v]
        if missing:
            raise ValueError(f"missing filters: {', '.join(missing)}")

    def check_plan(self, df: DataFrame) -> None:
        """ValueError unless the optimised plan filters every required column by its value."""
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        filters = " ".join(line for line in plan.splitlines() if "Filter" in line or "PushedFilters" in line)
        import re

        missing = [f"{k} = {v!r}" for k, v in self.required.items() if not re.search(rf"\b{re.escape(k)}#[0-9]+L? = {re.escape(str(v))}(?![A-Za-z0-9_])", filters)]
        if missing:
            raise ValueError(f"the plan does not filter {', '.join(missing)}")

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(all_of(F.col(k) == v for k, v in self.required.items()))


#: Required filters of the datasets: fixed values.
POLICIES = {
    "fundamentals": FilterPolicy(indfmt="INDL", datafmt="STD", popsrc="D", consol="C"),
    "monthly_stock": FilterPolicy(sharetype="NS", securitytype="EQTY", securitysubtype="COM", usincflg="Y"),
    "insider": FilterPolicy(acqdisp="D"),
}


def fuzzy_match(names: DataFrame, companies: DataFrame, name: str = "name", company: str = "company", threshold: float = 0.7) -> DataFrame:
    """Companies similar to a name: candidates share its first word, then the match ratio decides.

    The ratio is at most twice the shorter length over the sum of both, so that pairs of too unlike
    lengths never reach Python.
    """
    from ..functions.text import similarity

    first = lambda c: F.element_at(F.split(F.upper(F.trim(c)), r"\s+"), 1)
    met = names.withColumn("_block", first(name)).join(companies.withColumn("_with", first(company)), F.col("_block") == F.col("_with"))
    a, b = F.length(name), F.length(company)
    met = met.filter(2 * F.least(a, b) >= threshold * (a + b))
    scored = met.drop("_block", "_with").withColumn("ratio", similarity(F.upper(name), F.upper(company)))
    return scored.filter(F.col("ratio") >= threshold)
