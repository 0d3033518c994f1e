"""Functions of numbers, dates, identifiers and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_cik(cik: Column) -> Column:
    """Zeros up to 10 digits; longer values stay as they are."""
    return F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)


def unpad(number: Column) -> Column:
    return F.ltrim(number, F.lit("0"))


def plain_cik(cik: Column) -> Column:
    return cik.cast("bigint").cast("string")


def cusip8(cusip: Column) -> Column:
    return F.substring(cusip, 1, 8)


#: The stylesheet of the viewer of insider filings: a fixed value.
VIEWER = "xslF345X03/primarydocument.xml"


def filing_urls(cik: Column, accession: Column, host: str, document: Column | None = None) -> dict[str, Column]:
    """Folder, one document, viewer, index page and full text of a filing."""
    bare = F.replace(accession, F.lit("-"), F.lit(""))
    folder = F.concat(F.lit(f"{host}/Archives/edgar/data/"), plain_cik(cik), F.lit("/"), bare)
    below = lambda *parts: F.concat(folder, F.lit("/"), *parts)
    out = {"folder": folder, "viewer": below(F.lit(VIEWER)), "index": below(accession, F.lit("-index.htm")), "full_text": below(accession, F.lit(".txt"))}
    return out | {"document": below(document)} if document is not None else out


def document_names(accession: Column, ticker: Column, year: Column) -> Column:
    """Names under which the main document of an annual report is tried, in order."""
    low = F.lower(ticker)
    return F.array(F.concat(accession, F.lit(".txt")), F.concat(low, F.lit("-"), year.cast("string"), F.lit("1231.htm")), F.concat(low, F.lit("10k.htm")), F.lit("10-k.htm"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


#: MIME types by suffix for each use, and what a use takes for other suffixes: fixed values.
_IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}
MIME = {
    "media": {
        ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heif", ".gif": "image/gif",
        ".mp4": "video/mp4", ".mpeg": "video/mpeg", ".mpg": "video/mpeg", ".mov": "video/mov", ".avi": "video/avi", ".flv": "video/x-flv",
        ".webm": "video/webm", ".wmv": "video/wmv", ".3gpp": "video/3gpp", ".3gp": "video/3gpp",
        ".wav": "audio/wav", ".mp3": "audio/mp3", ".aiff": "audio/aiff", ".aac": "audio/aac", ".ogg": "audio/ogg", ".flac": "audio/flac",
        ".pdf": "application/pdf", ".txt": "text/plain", ".csv": "text/csv", ".md": "text/markdown",
        ".html": "text/html", ".htm": "text/html", ".json": "application/json", ".xml": "application/xml",
    },
    "batch": {".pdf": "application/pdf", ".gif": "image/gif"} | _IMAGES,
    "icon": {".svg": "image/svg+xml"} | _IMAGES,
}
MIME_DEFAULTS = {"batch": "application/octet-stream", "media": "application/octet-stream", "icon": "image/png"}


def mime_type(path: Column, use: str = "batch") -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME[use].items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit(MIME_DEFAULTS[use]))


#: The checker of each kind of source file, by suffix in lower case: fixed values.
HANDLERS = {".py": "python", ".r": "r", ".do": "stata", ".ado": "stata", ".sas": "sas", ".md": "markdown", ".markdown": "markdown"}


def handler(path: Column) -> Column:
    """The checker that takes a file; null for other suffixes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in HANDLERS.items() for x in pair]), suffix(path))


def thousands(value: Column, decimals: int = 2) -> Column:
    """A number with thousands separators and fixed decimals, rounded half to even."""
    return F.format_number(F.bround(value.cast("decimal(28,10)"), decimals), decimals)


def signed(value: Column, decimals: int = 1) -> Column:
    """A number with its sign and fixed decimals, rounded half to even; zero has a plus."""
    rounded = F.bround(value.cast("decimal(28,10)"), decimals)
    return F.concat(F.when(rounded < 0, "").otherwise("+"), F.replace(F.format_number(rounded, decimals), F.lit(","), F.lit("")))


def ratios(**c: Column) -> dict[str, Column]:
    """The eight ratios of a company's accounts; null where the denominator is null or zero."""
    over = lambda a, b: F.try_divide(a, b)
    return {
        "net_margin": over(c["ni"], c["revt"]), "roa": over(c["ni"], c["at"]), "roe": over(c["ni"], c["seq"]),
        "debt_to_assets": over(c["lt"], c["at"]), "debt_to_equity": over(c["dltt"] + c["dlc"], c["seq"]),
        "cash_ratio": over(c["che"], c["at"]),
        "pe_ratio": over(c["mkvalt"], c["ni"]), "pb_ratio": over(c["mkvalt"], c["seq"]),
    }


def relative_day(today: Column, back: int = 0, unit: str = "day") -> Column:
    """The day so many days, weekdays or years (of 365 days) before ``today``."""
    if unit == "weekday":
        day = today
        for _ in range(back):
            day = F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))
        return day
    return F.date_sub(today, back * {"day": 1, "year": 365}[unit])


def has_suffix(path: Column, *suffixes: str) -> Column:
    return suffix(path).isin(*suffixes)


def request_id(path: Column, content: Column, prompt: Column, long: bool = False) -> Column:
    """Stem, start of the content's digest and of the prompt's: the same for the same input."""
    if long:
        return F.concat_ws("_", stem(path), F.left(F.sha2(content, 256), F.lit(12)), F.left(F.sha2(prompt, 256), F.lit(8)))
    return F.concat_ws("_", stem(path), F.left(F.md5(content), F.lit(8)), F.left(F.md5(prompt), F.lit(6)))


def sas_date(days: Column) -> Column:
    """Days since 1960-01-01 as a date."""
    return F.date_add(F.lit("1960-01-01").cast("date"), days.cast("int"))


def fiscal_period(code: Column) -> Column:
    """(unit, offset) of a relative period such as FY0 or FQ-4; null for others."""
    pattern = r"^(FY|FQ|FS|CY|CQ)([+-]?\d+)$"
    return F.when(code.rlike(pattern), F.struct(F.regexp_extract(code, pattern, 1).alias("unit"), F.regexp_extract(code, pattern, 2).cast("int").alias("offset")))


def score_band(score: Column) -> Column:
    """Quarter of a score from 0 to 100; an edge belongs to the band above it."""
    return F.when(score < 25, "poor").when(score < 50, "satisfactory").when(score < 75, "good").when(score.isNotNull(), "excellent")


#: Planning of batches: fixed values. Most requests of a batch by mean size (above so many MB), and the share that critical work takes.
BATCH_MOST, BATCH_BY_SIZE, BATCH_SHARES, BATCH_SHARE = 10_000, ((10, 500), (5, 1_000)), {"low": 1.0, "high": 0.2}, 0.5


def optimal_batch(files: Column, mean_mb: Column, criticality: Column) -> Column:
    """Requests for each batch: files dealt evenly to full batches, none above the most that size and criticality allow."""
    cap = reduce(lambda rest, edge: F.when(mean_mb > edge[0], edge[1]).otherwise(rest), reversed(BATCH_BY_SIZE), F.lit(BATCH_MOST))
    share = reduce(lambda rest, kind: F.when(criticality == kind, BATCH_SHARES[kind]).otherwise(rest), BATCH_SHARES, F.lit(BATCH_SHARE))
    most = F.floor(cap * share)
    return F.least(F.floor(files / F.greatest(F.lit(1), F.floor(files / most))), most)


#: Dollars for a million tokens in and out: fixed values of the pricing note.
PRICES = {"flash-lite": (0.0375, 0.15)}


def batch_cost(tokens_in: Column, tokens_out: Column, model: str = "flash-lite") -> Column:
    a, b = PRICES[model]
    return tokens_in / 1e6 * a + tokens_out / 1e6 * b


def salvage_json(text: Column) -> Column:
    """JSON in a model's answer: as it is, in a json fence, in any fence, from the first brace (or bracket) to the last; else null."""
    fence = lambda tag: F.nullif(F.regexp_extract(text, rf"(?s)```{tag}\s*\n?(.*?)```", 1), F.lit(""))
    part = lambda a, b: F.nullif(F.regexp_extract(text, rf"(?s){a}.*{b}", 0), F.lit(""))
    attempts = [text, fence("json"), fence("[A-Za-z]*"), part(r"\{", r"\}"), part(r"\[", r"\]")]
    return F.coalesce(*[F.try_parse_json(a) for a in attempts])


def category_codes(column: str, order) -> Column:
    """Codes from 0 in sorted order; null keeps null."""
    return F.when(F.col(column).isNotNull(), F.dense_rank().over(order) - 1)


def isbn_valid(code: Column) -> Column:
    """Whether an ISBN of 10 or 13 characters has a right check digit."""
    bare = F.upper(F.regexp_replace(code, r"[\s-]", ""))
    digit = lambda c: F.when(c == "X", 10).otherwise(F.try_to_number(c, F.lit("9"))).cast("int")
    chars = F.split(bare, "")
    weighted = lambda w: F.aggregate(F.transform(chars, lambda c, i: F.coalesce(digit(c), F.lit(99)) * w(i)), F.lit(0), lambda a, b: a + b)
    ten = bare.rlike("^[0-9]{9}[0-9X]$") & (weighted(lambda i: 10 - i) % 11 == 0)
    thirteen = bare.rlike("^[0-9]{13}$") & (weighted(lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0)
    return ten | thirteen


def isbns(text: Column) -> Column:
    """What looks like an ISBN in a text: runs of 10 or 13 digits (the last may be X), hyphens allowed between."""
    return F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z-])((?:97[89]-?)?(?:[0-9]-?){9}[0-9Xx])(?![0-9A-Za-z-])"), F.lit(1))


def dois(text: Column) -> Column:
    """What has the shape of a DOI in a text."""
    return F.regexp_extract_all(text, F.lit(r"10\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+"), F.lit(0))


def adjusted(value: str, factor: str, order) -> Column:
    """A price times the product of all later factors; ``order`` holds the rows after the current one."""
    return F.col(value) * F.coalesce(F.product(factor).over(order), F.lit(1.0))
