"""Profiles, audits and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def profile(df: DataFrame, date: str | None = None) -> dict[str, DataFrame]:
    """The mandatory profile: types, counts, description, nulls, duplicates, and the range of a date."""
    out = {
        "dtypes": df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string"),
        "shape": df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns")),
        "describe": stats.describe_exact(df) if stats.numeric(df) else None,
        "nulls": stats.null_counts(df),
        "duplicates": stats.duplicate_count(df),
        "head": df.limit(5),
        "value_counts": {c: stats.value_counts(df, c) for c, t in df.dtypes if t == "string"},
    }
    if date:
        out["dates"] = df.agg(F.min(date).alias("first"), F.max(date).alias("last"))
    return {k: v for k, v in out.items() if v is not None}


def filter_audit(df: DataFrame, condition: Column) -> DataFrame:
    """Rows before and after a filter and the share removed, in one pass."""
    kept = F.count_if(condition)
    return df.agg(F.count("*").alias("before"), kept.alias("after"), (100 * F.try_divide(F.count("*") - kept, F.count("*"))).alias("pct_removed"))


def join_audit(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join's rows before and after, rows without a match, and how often a key repeats on the right."""
    tagged = right.select(*on).groupBy(*on).agg(F.count("*").alias("_n"))
    met = left.join(tagged, on, "left")
    return met.agg(F.count("*").alias("left_rows"), F.sum(F.coalesce("_n", F.lit(1))).alias("joined_rows"), F.count_if(F.col("_n").isNull()).alias("unmatched"), F.max("_n").alias("most_matches"))


def assert_not_empty(df: DataFrame, what: str = "result") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def issues(df: DataFrame, column: str) -> DataFrame:
    """The issues of a numeric column: missing, repeated, outliers by quartile range, cardinality, skew."""
    q = stats.quantiles(df, [], column, 0.25, 0.75).select(F.col("p25").alias("q1"), F.col("p75").alias("q3"))
    out = (F.col(column) < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col(column) > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    rows = df.select(column).join(F.broadcast(q))
    return rows.agg(F.count_if(F.col(column).isNull()).alias("missing"), (F.count(column) - F.count_distinct(column)).alias("repeated"), F.count_if(out).alias("outliers"), F.count_distinct(column).alias("distinct_values"), F.skewness(column).alias("skew"))


#: What must be shown after each kind of operation: fixed values.
REQUIRED = {
    "load": ("shape", "dtypes", "head"),
    "filter": ("before", "after", "pct_removed"),
    "join": ("shape", "nulls", "sample"),
    "group": ("shape", "sample"),
    "transform": ("before", "after", "sample"),
    "fit": ("metrics", "convergence"),
    "predict": ("distribution", "sample"),
}


def audited(operation: str, result: DataFrame, before: DataFrame | None = None, sample: int = 5, **shown) -> dict:
    """The outputs that ``REQUIRED`` asks for after an operation; ValueError names those that can't be made.

    Those of a model (metrics, convergence, distribution) must be passed.
    """
    rows = lambda df: df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))
    made: dict = dict(shown)
    if operation == "filter" and before is not None:
        a, b = rows(before).first().rows, rows(result).first().rows
        made |= {"before": a, "after": b, "pct_removed": 100 * (a - b) / a if a else None}
    elif before is not None:
        made |= {"before": rows(before), "after": rows(result)}
    made |= {"shape": rows(result), "dtypes": result.dtypes, "head": result.limit(sample), "sample": result.limit(sample), "nulls": stats.null_counts(result)}
    missing = [k for k in REQUIRED[operation] if k not in made]
    if missing:
        raise ValueError(f"{operation} must show {', '.join(missing)}")
    return {k: made[k] for k in REQUIRED[operation]}


def post_query(df: DataFrame, critical: list[str], date: str | None = None) -> DataFrame:
    """One row after a query: its rows, nulls in each critical column, and the range of a date."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in critical]
    dates = [F.min(date).alias("first"), F.max(date).alias("last")] if date else []
    return df.agg(F.count("*").alias("rows"), *nulls, *dates)


def assert_requests(lines: DataFrame, **names) -> None:
    """ValueError with the first findings, by line, if any line of batch requests has an error."""
    found = validate_requests(lines, **names).filter("severity = 'error'").orderBy("line_no", "message").limit(10).collect()
    if found:
        raise ValueError("; ".join(f"line {r.line_no}: {r.message}" for r in found))


def confident(df: DataFrame, column: str = "confidence", least: float = 80) -> DataFrame:
    return df.filter(F.col(column) >= least)


def page_ranges(pages: Column, size: int = 50) -> Column:
    """First pages (from 0) of the parts of a document that is split at ``size`` pages."""
    return F.sequence(F.lit(0), F.greatest(pages - 1, F.lit(0)), F.lit(size))


_REQUEST = (
    "request struct<contents:array<struct<role:string,parts:array<struct<fileData:struct<fileUri:string,mimeType:string>,text:string>>>>>, metadata struct<request_id:string>"
)


def validate_requests(lines: DataFrame, strict: bool = False, line_no: str = "line_no", line: str = "value") -> DataFrame:
    """Findings (line_no, severity, message) on lines of batch requests.

    Blank lines and missing ids are warnings, or errors with ``strict``. A line is checked up to its
    first structural fault. Repeats of an id are errors from the second line on.
    """
    raw = F.trim(F.col(line))
    rows = lines.select(F.col(line_no).alias("line_no"), raw.alias("raw"), F.try_parse_json(raw).alias("json"), F.from_json(raw, _REQUEST).alias("r"))
    has = lambda path: F.expr(f"try_variant_get(json, '{path}', 'variant')").isNotNull()
    first = F.try_element_at("r.request.contents", F.lit(1))
    uris = F.transform(F.filter(first["parts"], lambda p: p["fileData"].isNotNull()), lambda p: F.coalesce(p["fileData"]["fileUri"], F.lit("")))
    rows = rows.select("line_no", "raw", F.col("json").isNotNull().alias("parsed"), has("$.request").alias("has_request"), has("$.request.contents").alias("has_contents"), F.coalesce(F.size("r.request.contents"), F.lit(0)).alias("n"), first["role"].alias("role"), F.coalesce(uris, F.array()).alias("uris"), F.nullif(F.col("r.metadata.request_id"), F.lit("")).alias("id"))
    alone = F.when(F.col("id").isNull(), F.col("line_no"))  # lines without an id don't meet in one task
    nth = F.row_number().over(Window.partitionBy("id", alone).orderBy("line_no"))
    rows = rows.withColumn("nth", F.when(F.col("id").isNotNull(), nth))
    soft = "error" if strict else "warning"
    say = lambda when, severity, text: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("message")))
    blank, bad = F.col("raw") == "", ~F.col("parsed")
    no_request, no_contents = ~F.col("has_request"), ~F.col("has_contents")
    whole = ~blank & ~bad & ~no_request & ~no_contents
    found = F.array_compact(
        F.array(
            say(blank, soft, "empty line"),
            say(~blank & bad, "error", "invalid JSON"),
            say(~blank & ~bad & no_request, "error", "missing request"),
            say(~blank & ~bad & ~no_request & no_contents, "error", "missing contents"),
            say(whole & (F.col("n") <= 0), "error", "empty contents"),
            say(whole & (F.col("n") > 0) & (F.coalesce("role", F.lit("")) != "user"), "error", "first role is not user"),
            say(whole & F.exists("uris", lambda u: ~u.startswith("gs://")), "error", "fileUri is not gs://"),
            say(whole & (F.col("nth") > 1), "error", "duplicate request_id"),
            say(whole & F.col("id").isNull(), soft, "missing request_id"),
        )
    )
    return rows.select("line_no", F.inline(found))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """A row for each cell of notebook documents (``path``, ``value``): its number, error outputs, whether it ran."""
    shape = "cells array<struct<cell_type:string,execution_count:int,outputs:array<struct<output_type:string,ename:string,evalue:string>>>>"
    cells = notebooks.select("path", F.posexplode(F.from_json("value", shape)["cells"]).alias("cell", "c"))
    errors = F.size(F.filter(F.coalesce("c.outputs", F.array().cast("array<struct<output_type:string,ename:string,evalue:string>>")), lambda o: o["output_type"] == "error"))
    return cells.select("path", "cell", F.col("c.cell_type").alias("cell_type"), errors.alias("errors"), F.col("c.execution_count").isNotNull().alias("ran"))
