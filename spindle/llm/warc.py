"""Content-addressed WARC archive.

``payloads`` holds each distinct payload once under its SHA-256; ``headers`` holds the exact header
block of every record and the digest it belongs to. Records are put together by a join. Equal
digests are verified: within a group SHA-1 and length must agree too, and reading recomputes the
digests from the bytes and fails on a mismatch. No expression leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hexadecimal digits are four letters."""
    digits = F.sha1(payload)
    groups = F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), lambda i: F.conv(F.substring(digits, i, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, bits: F.substring(F.lit(BASE32), F.shiftright(v, bits).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(*[letter(v, b) for b in (15, 10, 5, 0)])), "")


def _urn(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; null, which is left out, for a null value. Line ends in a value are escaped."""
    value = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), value)


def write_archive(pages: DataFrame, path: str, *, min_payload: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``min_payload`` bytes the one with the largest
    page_id is the response and the others revisit it; smaller ones are all responses. A null html
    is an empty payload, a null url leaves its line out, a null page_id never is the response if
    another has an id. Rows that repeat the response's page_id are responses too. Other columns
    are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    same = F.min("sha1") == F.max("sha1")
    (
        rows.withColumn("sha1", F.sha1("payload"))
        .groupBy("sha256")
        .agg(F.first("payload").alias("payload"), F.max("page_id").alias("keeper"), F.min(F.length("payload")).alias("n"), F.max(F.length("payload")).alias("n2"), same.alias("same"))
        .filter(F.when(F.col("same") & (F.col("n") == F.col("n2")), True).otherwise(F.raise_error(F.lit("different payloads with one SHA-256"))))
        .select("sha256", "payload", "keeper")
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )
    kept = pages.sparkSession.read.parquet(f"{path}/payloads").select(F.col("sha256").alias("key"), "keeper")
    rows = rows.select("page_id", "url", "sha256", F.length("payload").alias("n"), base32_sha1(F.col("payload")).alias("digest"))
    rows = rows.join(kept, F.col("sha256") == F.col("key"))
    again = (F.col("n") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    header = F.concat(
        F.concat_ws(
            "\r\n",
            F.lit("WARC/1.1"),
            F.when(again, "WARC-Type: revisit").otherwise("WARC-Type: response"),
            _line("WARC-Record-ID", _urn(F.col("page_id"))),
            F.lit(f"WARC-Date: {date}"),
            _line("WARC-Target-URI", F.col("url")),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(again, _line("WARC-Refers-To", _urn(F.col("keeper")))),
            F.when(again, F.lit(f"WARC-Profile: {REVISIT}")),
            _line("X-Page-ID", F.col("page_id")),
            F.when(again, _line("X-Refers-To-Page", F.col("keeper"))),
            F.lit("Content-Type: text/html; charset=utf-8"),
            _line("Content-Length", F.when(again, 0).otherwise(F.col("n"))),
        ),
        F.lit("\r\n\r\n"),
    )
    rows.select("sha256", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.col("header").contains(f"\r\n{name}: "), found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``sha256``, the header block and the fields parsed from it."""
    return spark.read.parquet(f"{path}/headers").select(
        "sha256",
        "header",
        _field("X-Page-ID").cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field("X-Refers-To-Page").cast("long").alias("refers_to"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Each payload with its length and base32 SHA-1, checked against the digest it is kept under."""
    rows = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    rows = rows.filter(F.when(sound, True).otherwise(F.raise_error(F.lit("a payload does not match its digest"))))
    return rows.select("sha256", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: its fields, its full payload, and the record as WARC writes it."""
    rows = read_headers(spark, path).join(read_payloads(spark, path), "sha256")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    rows = rows.filter(F.when(F.col("payload_digest") == F.col("digest"), True).otherwise(F.raise_error(F.lit("a header names another digest"))))
    return rows.withColumn("record", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n"))).drop("digest")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write_archive(common.table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p),
b AS (SELECT *, list_transform(generate_series(0, 7), lambda g: CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT)) AS v FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM b
"""
