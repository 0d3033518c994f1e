"""Nested vendor documents (JSON text) as flat rows: fund modules, dated holdings, filing lists, news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modules of a fund document and the list in each that has the rows: fixed values of the interface.
MODULES = {"KEY": None, "MD": None, "BEN": "benchmarks", "PFM": "performance", "TTH": "holdings", "FEE": "fees", "INC": "distributions", "CLA": "classifications"}
_HOLDING = "struct<ric:string,name:string,domicile:string,percent:double,shares:double,sharesChange:double>"
_HOLDINGS = f"results array<struct<availableDates:array<string>,date:string,groups:array<struct<id:string,name:string,items:array<{_HOLDING}>>>>>"


def fund_module(docs: DataFrame, module: str, fields: str, key: str = "fund", text: str = "json") -> DataFrame:
    """A row for each entry of a module of each fund: ``key`` and the ``fields`` (as in a schema).

    A module without a list has its fields in the result itself. Documents that are no JSON, or say
    that they are in error, give no rows.
    """
    part = MODULES[module]
    of = f"struct<{fields}>"
    shape = f"isError boolean, results array<{of if part is None else f'struct<{part}:array<{of}>>'}>"
    docs = docs.select(key, F.from_json(text, shape).alias("d")).filter(~F.coalesce(F.col("d.isError"), F.lit(False)))
    rows = docs.select(key, F.explode("d.results").alias("r"))
    return rows.select(key, "r.*") if part is None else rows.select(key, F.inline(f"r.{part}"))


def available_dates(docs: DataFrame, key: str = "fund", text: str = "json") -> DataFrame:
    """``(key, date)`` of every date for which a fund has holdings."""
    results = docs.select(key, F.explode(F.from_json(text, _HOLDINGS)["results"]).alias("r"))
    return results.select(key, F.explode("r.availableDates").alias("d")).select(key, F.col("d").cast("date").alias("date")).distinct()


def holdings(docs: DataFrame, key: str = "fund", text: str = "json") -> DataFrame:
    """A row for each item of each group of each dated result: three levels, flat."""
    results = docs.select(key, F.explode(F.from_json(text, _HOLDINGS)["results"]).alias("r"))
    groups = results.select(key, F.col("r.date").cast("date").alias("date"), F.explode("r.groups").alias("g"))
    return groups.select(key, "date", F.col("g.name").alias("group"), F.inline("g.items"))


def as_of(rows: DataFrame, day: Column, key: str = "fund", date: str = "date") -> DataFrame:
    """The rows of each key on its latest date that isn't after ``day``."""
    last = rows.filter(F.col(date) <= day).groupBy(F.col(key).alias("_k")).agg(F.max(date).alias("_d"))
    return rows.join(last, (F.col(key) == F.col("_k")) & (F.col(date) == F.col("_d"))).drop("_k", "_d")


def submissions(docs: DataFrame, text: str = "json") -> DataFrame:
    """A row for each recent filing of each company's submissions: parallel arrays, zipped."""
    recent = "struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,primaryDocument:array<string>>"
    d = F.from_json(text, f"cik string, name string, filings struct<recent:{recent}>")
    r = d["filings"]["recent"]
    zipped = F.arrays_zip(r["accessionNumber"].alias("accession"), r["filingDate"].alias("filed"), r["form"].alias("form"), r["primaryDocument"].alias("document"))
    rows = docs.select(F.lpad(d["cik"], 10, "0").alias("cik"), d["name"].alias("company"), F.inline(zipped))
    return rows.withColumn("filed", F.col("filed").cast("date"))


def stories(headlines: DataFrame, texts: DataFrame, story: str = "story_id") -> DataFrame:
    """Headlines with the text of their story, null where there is none."""
    return headlines.join(texts.select(story, F.col("text").alias("story")), story, "left")


def newest_headlines(rows: DataFrame, condition: Column, start: str, end: str, count: int = 100, at: str = "at", *ties: str) -> DataFrame:
    """The newest headlines of a query from ``start`` to before ``end``, ``count`` (100 at most) of them."""
    inside = (F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz"))
    return rows.filter(condition & inside).orderBy(F.col(at).desc(), *ties).limit(min(count, 100))


def point_in_time(facts: DataFrame, universe: DataFrame, fields: list[str], day: str | None = None, key: str = "instrument", field: str = "field", value: str = "value", at: str = "at") -> DataFrame:
    """A row for each instrument with its latest value of each field, as known on ``day`` if one is given."""
    rows = facts.join(universe.select(key).distinct(), key, "left_semi").filter(F.col(field).isin(*fields))
    rows = rows.filter(F.col(at) <= F.lit(day).cast("timestamp_ntz")) if day else rows
    known = rows.groupBy(key).pivot(field, fields).agg(F.max_by(value, at))
    return universe.select(key).distinct().join(known, key, "left")


#: Local times from which each session runs, in minutes of the day: fixed values of an exchange.
SESSIONS = {"PRE": (4 * 60, 9 * 60 + 30), "NORMAL": (9 * 60 + 30, 16 * 60), "POST": (16 * 60, 20 * 60)}


def in_sessions(at: Column, *sessions: str) -> Column:
    """Whether a local time lies in one of the sessions."""
    minute = F.hour(at) * 60 + F.minute(at)
    hits = [(minute >= a) & (minute < b) for a, b in (SESSIONS[s] for s in sessions)]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def summaries(trades: DataFrame, interval: str, count: int, key: str, at: str, price: str, order: str, sessions: tuple = ()) -> DataFrame:
    """The last ``count`` bars of each key, of trades in the sessions: open, high, low, close and trades."""
    from pyspark.sql import Window

    rows = trades.filter(in_sessions(F.col(at), *sessions)) if sessions else trades
    by = F.struct(at, order)
    bars = rows.groupBy(key, F.window(F.col(at).cast("timestamp"), interval)["start"].cast("timestamp_ntz").alias("start")).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.count("*").alias("trades")
    )
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("start").desc()))
    return bars.withColumn("_nth", nth).filter(F.col("_nth") <= count).drop("_nth")


def screened(rows: DataFrame, screen: DataFrame, key: str) -> DataFrame:
    """Rows of the instruments that a screen selects: the screen is the universe."""
    return rows.join(screen.select(key).distinct(), key, "left_semi")


def field_catalogue(docs: DataFrame, text: str = "json", most_chars: int | None = None) -> DataFrame:
    """``(name, type, description)`` of the fields that catalogue documents list; larger documents than ``most_chars`` go."""
    docs = docs.filter(F.length(text) <= most_chars) if most_chars is not None else docs
    shape = "universe array<struct<name:string,type:string,description:string>>"
    return docs.select(F.inline(F.from_json(text, shape)["universe"])).distinct()
