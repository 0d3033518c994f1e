"""Bookkeeping of batch extraction: requests, results, manifests, planning.

The model itself is a client that is passed in; tests use a fake one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .relational import dedupe_keep

#: The wire format of answers, and that of requests in :func:`requests`: fixed values of the interface.
RESULT = "metadata struct<request_id:string>, response struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>>, error string"


def requests(files: DataFrame, prompt: str, uri: str = "uri", content: str = "content", temperature: float = 0.0) -> DataFrame:
    """``(request_id, line)``: the JSON request of each file."""
    file = F.struct(F.struct(F.col(uri).alias("fileUri"), scalars.mime_type(F.col(uri)).alias("mimeType")).alias("fileData"))
    words = F.struct(F.lit(prompt).alias("text"))
    part = lambda p, n: F.to_json(p)
    parts = F.concat(F.lit("["), part(file, 0), F.lit(","), part(words, 1), F.lit("]"))
    rid = scalars.request_id(F.col(uri), F.col(content), F.lit(prompt))
    line = F.concat(
        F.lit('{"request":{"contents":[{"role":"user","parts":'), parts,
        F.lit(f'}}],"generationConfig":{{"temperature":{temperature},"responseMimeType":"application/json"}}}},"metadata":{{"request_id":"'), rid, F.lit('"}}'),
    )
    return files.select(rid.alias("request_id"), line.alias("line"))


def parse_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(request_id, success, text, parsed, finish_reason)``; success means that a candidate exists."""
    r = F.from_json(F.col(line), RESULT)
    first = F.try_element_at(r["response"]["candidates"], F.lit(1))
    text = F.try_element_at(first["content"]["parts"], F.lit(1))["text"]
    rows = lines.select(r["metadata"]["request_id"].alias("request_id"), first.isNotNull().alias("success"), text.alias("text"), first["finishReason"].alias("finish_reason"))
    return rows.withColumn("parsed", F.to_json(scalars.salvage_json(F.col("text"))))


def jobs(requests: DataFrame, order: str, size: int = 10_000) -> DataFrame:
    """The job of each request when jobs take ``size`` requests."""
    from .relational import chunked

    return chunked(requests, order, size, name="job")


def upsert(manifest: DataFrame, changes: DataFrame, key: str = "request_id", at: str = "updated_at") -> DataFrame:
    """The manifest after changes: the newest row of each request."""
    return dedupe_keep(manifest.unionByName(changes, allowMissingColumns=True), key, at, "last")


def pending(all_requests: DataFrame, manifest: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests that aren't completed."""
    return all_requests.join(manifest.filter("status = 'completed'").select(key), key, "left_anti")


def download_plan(filings: DataFrame, root: str) -> DataFrame:
    """Where each filing goes, all pending."""
    target = F.concat_ws("/", F.lit(root), scalars.plain_cik(F.col("cik")), F.date_format("file_date", "yyyyMMdd"), F.col("accession_number"))
    return filings.select("accession_number", F.concat(target, F.lit(".txt")).alias("path"), F.lit("pending").alias("status"))


def first_found(key: str, base: DataFrame, **tiers: DataFrame) -> DataFrame:
    """``text`` from the first tier that has it, and that tier's name."""
    out = base
    for name, frame in tiers.items():
        out = out.join(frame.select(key, F.col("text").alias(f"_{name}")), key, "left")
    named = [F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in tiers]
    return out.withColumn("text", F.coalesce(*[F.col(f"_{n}") for n in tiers])).withColumn("tier", F.coalesce(*named)).drop(*[f"_{n}" for n in tiers])


def call_model(files: DataFrame, client: Callable[[], Callable[[str, bytes], str]], key: str, content: str) -> DataFrame:
    """``(key, answer, error)``: a client is made once for each partition and asked for each row."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for rows in batches:
            out = []
            for k, c in zip(rows[key], rows[content]):
                try:
                    out.append((k, ask(k, c), None))
                except Exception as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"{key} {kind}, answer string, error string")


def retry(failed: DataFrame, run: Callable[[DataFrame], DataFrame], times: int = 3) -> DataFrame:
    """Runs the failed rows again, up to ``times``; the last answer of each counts.

    A round that is over is released; what it answered stays cached in the one table that grows.
    """
    done, key = None, None
    for turn in range(times):
        out = run(failed).cache()
        key = out.columns[0]
        last = turn == times - 1 or out.filter("error is not null").isEmpty()
        more = out if last else out.filter("error is null")
        joined = (more if done is None else done.unionByName(more)).cache()
        joined.count()
        if done is not None:
            done.unpersist()
        done = joined
        if last:
            return done
        failed = failed.join(out.filter("error is not null").select(key), key, "left_semi")
    return done


def step_log(df: DataFrame, step: str) -> DataFrame:
    """One row: the step, its rows and a checksum that doesn't depend on order."""
    from .stats import content_hash

    return content_hash(df).select(F.lit(step).alias("step"), "rows", F.col("fingerprint").alias("checksum"))
