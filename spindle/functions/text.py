"""Functions of text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's ratio of matching characters; no built-in function equals it."""
    import pandas as pd

    def ratio(x, y):
        from difflib import SequenceMatcher

        pairs = ((p, q) if p is not None and q is not None else None for p, q in zip(x, y))
        return pd.Series([SequenceMatcher(None, *p).ratio() if p else None for p in pairs], dtype="float64")

    ratio.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return pandas_udf(ratio, "double")(a, b)


def _curled(text: Column) -> Column:
    out = F.regexp_replace(text, r'(^|[\s(\[{])"', "$1“")
    out = F.regexp_replace(out, '"', "”")
    out = F.regexp_replace(out, r"(^|[\s(\[{])'", "$1‘")
    return F.regexp_replace(out, "'", "’")


#: Code: fences of three backticks, single backticks on a line, pre and code elements.
_CODE = r"```.*?(?:```|\z)|`[^`\n]*`|<(?:pre|code)[ >].*?</(?:pre|code)>"


def smart_quotes(text: Column) -> Column:
    """Straight quotes become typographic ones: opening after a space or bracket, else closing; code stays.

    Parts beside code are converted each for itself.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)(?:{_CODE})|.+?(?={_CODE}|\z)"), F.lit(0))
    made = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(rf"(?s)\A(?:{_CODE})\z"), x).otherwise(_curled(x))), "")
    return F.when(text.rlike("[`<]"), made).otherwise(_curled(text))


def changed_lines(before: Column, after: Column) -> Column:
    """Lines that differ at the same place: an array of (line, before, after)."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    pairs = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p, i: F.struct((i + 1).alias("line"), p["x"].alias("before"), p["y"].alias("after")))
    return F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"]))


#: Where a section of an annual report begins and ends: fixed values.
SECTIONS = {
    "Item 1": r"Item\s+1\.?\s+Business(.*?)Item\s+1A",
    "Item 1A": r"Item\s+1A\.?\s+Risk\s+Factors(.*?)Item\s+1B",
    "Item 7": r"Item\s+7\.?\s+Management.*?Discussion(.*?)Item\s+7A",
    "Item 7A": r"Item\s+7A\.?\s+Quantitative\s+and\s+Qualitative(.*?)Item\s+8",
    "Item 8": r"Item\s+8\.?\s+Financial\s+Statements(.*?)Item\s+9",
}


def section(text: Column, name: str) -> Column:
    """The named section, trimmed; null if it isn't there."""
    pattern = f"(?is){SECTIONS[name]}"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1), F.lit(" \t\r\n")))


def mask_secret(value: Column) -> Column:
    """First and last four characters of values longer than 12, else stars."""
    return F.when(F.length(value) > 12, F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4)))).when(value.isNotNull(), F.lit("***"))


def env_line(line: Column) -> Column:
    """(key, value) of a KEY=VALUE line; null for blank lines, comments and others."""
    pattern = r"^\s*([^#=\s][^=]*?)\s*=\s*(.*?)\s*$"
    value = F.regexp_replace(F.regexp_extract(line, pattern, 2), r"""^(["'])(.*)\1$""", "$2")
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("key"), value.alias("value")))


def env_values(lines: DataFrame, order: str, line: str = "value") -> DataFrame:
    """``(key, value)`` of KEY=VALUE lines; of a key that repeats, the first line in ``order`` counts."""
    held = lines.select(F.col(order).alias("_at"), env_line(F.col(line)).alias("kv")).filter("kv is not null")
    return held.groupBy(F.col("kv.key").alias("key")).agg(F.min_by(F.col("kv.value"), F.col("_at")).alias("value"))


FRONT = r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)"


def front_matter(text: Column) -> Column:
    """The block between the first two lines of three dashes; null without one."""
    return F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 1))


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT, "")


def front_field(text: Column, name: str) -> Column:
    """A field of the front matter; null if it isn't there."""
    return F.nullif(F.trim(F.regexp_extract(front_matter(text), rf"(?m)^{re.escape(name)}:[ \t]*(.*)$", 1)), F.lit(""))


def classify(text: Column, patterns: dict[str, str], other: str | None = None) -> Column:
    """The name of the first pattern that is found."""
    out = None
    for name, pattern in patterns.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"""https?://[^\s<>"')\]]+""", 0), F.lit(""))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def replace_footer(text: Column, footer: str, marker: str) -> Column:
    """The text with everything from ``marker`` on replaced by ``footer``; the same if done twice."""
    return F.concat(F.regexp_replace(text, rf"(?s)\s*{re.escape(marker)}.*\z", ""), F.lit(f"\n{marker}{footer}"))
