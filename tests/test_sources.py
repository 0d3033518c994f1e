import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindle.sources import files, vendor
from spindle.streaming import streams


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc", "feather", "dta"])
def test_round_trips(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 1.5, "a"), (2, 2.5, "b")], "i long, x double, s string")
    files.write(df, str(tmp_path / "t"), fmt)
    back = files.read(spark, str(tmp_path / "t"), fmt, "i long, x double, s string")
    assert sorted(map(tuple, back.collect())) == [(1, 1.5, "a"), (2, 2.5, "b")]


def test_stata_schema_is_found(spark, tmp_path):
    pd.DataFrame({"a": [1, 2], "b": ["x", "y"]}).to_stata(tmp_path / "t.dta", write_index=False)
    assert files.read(spark, str(tmp_path / "t.dta"), "dta").columns == ["a", "b"]
    with pytest.raises(ValueError):
        files.read(spark, "x", "csv")


def test_files_are_read_in_chunks_with_their_labels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 2)
    data = pd.DataFrame({"k": [1, 2, 1, 2, 1], "x": [0.5, None, 1.5, 2.5, 3.5], "d": pd.date_range("2020-01-01", periods=5)})
    data.to_stata(tmp_path / "t.dta", write_index=False, value_labels={"k": {1: "low", 2: "high"}}, version=118)
    got = files.read(spark, str(tmp_path / "t.dta"), "dta").orderBy("d").collect()
    assert [r.k for r in got] == [1, 2, 1, 2, 1] and [r.x for r in got] == [0.5, None, 1.5, 2.5, 3.5] and got[4].d.day == 5
    assert {(r.label_set, r.code, r.label) for r in files.value_labels(spark, str(tmp_path / "t.dta")).collect()} == {("k", 1, "low"), ("k", 2, "high")}
    import pyarrow as pa
    import pyarrow.feather

    pyarrow.feather.write_feather(pa.table({"a": list(range(10)), "t": [["x"]] * 10}), str(tmp_path / "t.feather"), chunksize=3)
    assert sorted(r.a for r in files.read(spark, str(tmp_path / "t.feather"), "feather").collect()) == list(range(10))


def test_lines_of_many_files(spark, tmp_path):
    (tmp_path / "in" / "job1").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "in" / "job1" / "b.jsonl").write_text('{"a":3}\n')
    (tmp_path / "in" / "c.txt").write_text("no\n")
    files.fetch_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']


def test_jobs_are_polled_with_growing_waits():
    now, waits = [0.0], []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    states = iter(["JOB_STATE_PENDING"] * 8 + ["JOB_STATE_SUCCEEDED"])
    assert streams.poll(lambda: next(states), 10_000, clock=lambda: now[0], sleep=sleep) == "JOB_STATE_SUCCEEDED"
    assert waits[:3] == [30.0, 45.0, 67.5] and waits[-1] == 300.0
    with pytest.raises(TimeoutError):
        streams.poll(lambda: "JOB_STATE_RUNNING", 100, clock=lambda: now[0], sleep=sleep)


def test_a_database_over_jdbc(spark, tmp_path):
    """Derby, which Spark brings along: a query, a partitioned read and a temporary view."""
    from spindle import catalog, session

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(30).selectExpr("id AS ID", "CAST(id % 3 AS INT) AS G").write.jdbc(url, "T", properties={"driver": driver})
    few = catalog.jdbc(spark, url, "SELECT ID, G FROM T WHERE G = 1", fetchsize=5, driver=driver)
    assert few.count() == 10
    parts = catalog.jdbc(spark, url, "SELECT ID, G FROM T", partition=("ID", 0, 30, 3), driver=driver)
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == 30
    assert catalog.first_row(parts.filter("ID = 7")).G == 1 and catalog.first_row(parts.filter("ID = 99")) is None
    assert session.ensured(spark) is spark and session.ensured(None, lambda: spark) is spark


def test_views_of_tables(spark, tmp_path):
    from spindle import catalog

    spark.range(3).write.parquet(f"{tmp_path}/region.parquet")
    catalog.register(spark, str(tmp_path), "region")
    assert spark.sql("SELECT count(*) AS n FROM region").first().n == 3 and catalog.accessible(spark, "region")


def test_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.PDF", "sub/b.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"12")
    got = files.listing(spark, str(tmp_path), ".pdf")
    assert got.count() == 2 and got.agg(F.sum("length")).first()[0] == 4


class FakeClient:
    """Three pages of a row for each day, with a rate limit on the first call."""

    calls = 0

    def fetch(self, instrument, fields, start, end, cursor):
        FakeClient.calls += 1
        if FakeClient.calls == 1:
            raise vendor.RateLimited
        day = datetime.date.fromisoformat(start) + datetime.timedelta(cursor or 0)
        after = (cursor or 0) + 1
        return [(instrument, day, float(after))], after if day.isoformat() < end else None


def test_vendor_pages_and_ranges(spark):
    waits = []
    FakeClient.calls = 0
    with pytest.raises(vendor.RateLimited):
        vendor.with_backoff(lambda: (_ for _ in ()).throw(vendor.RateLimited()), 3, 30, waits.append)
    assert waits == [30, 60]
    FakeClient.calls = 1
    assert len(list(vendor.pages(FakeClient(), "A", [], "2020-01-01", "2020-01-03"))) == 3
    assert len(list(vendor.pages(FakeClient(), "A", [], "2020-01-01", "2020-01-03", most=2))) == 2
    now = [0.0]
    limiter = vendor.Limiter(2, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limiter()
    assert now[0] == 2.0


def test_vendor_source(spark):
    class Client:
        def fetch(self, instrument, fields, start, end, cursor):
            import datetime

            a, b = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
            return [(instrument, a + datetime.timedelta(i), 1.0) for i in range((b - a).days + 1)], None

    df = vendor.history(spark, Client, "instrument string, day date, close double", ["A", "B"], "2020-01-01", "2020-01-11", days=10, rate=1000)
    got = df.groupBy("instrument").agg(F.count("*").alias("n"), F.max("day").alias("last")).collect()
    assert {(r.instrument, r.n, r["last"].isoformat()) for r in got} == {("A", 11, "2020-01-11"), ("B", 11, "2020-01-11")}


def _events(spark):
    return spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user"), (F.lit(1_700_000_000) + F.col("id") * 300).cast("timestamp").alias("ts"), (F.col("id") * 1.5).alias("value"))


def test_stream_equals_batch(spark, tmp_path):
    df = _events(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.files(spark, str(tmp_path / "in"), df.schema)
    streams.to_memory(streams.windowed(stream, "ts", "1 hour", "user"), "hourly").awaitTermination()
    assert sorted(spark.table("hourly").collect()) == sorted(streams.windowed(df, "ts", "1 hour", "user").collect())
    streams.to_memory(streams.latest(stream, "user", "ts", "value"), "newest").awaitTermination()
    assert sorted(spark.table("newest").collect()) == sorted(streams.latest(df, "user", "ts", "value").collect())
    streams.to_memory(streams.ohlc(stream, "ts", "1 hour", "user", "value", "event_id"), "bars").awaitTermination()
    assert spark.table("bars").count() == streams.ohlc(df, "ts", "1 hour", "user", "value", "event_id").count()
    assert streams.sessions(df, "ts", "10 minutes", "user").count() > 0


def test_only_new_files_are_processed(spark, tmp_path):
    df = _events(spark)
    schema = df.schema
    df.filter("event_id < 100").write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: streams.wait(streams.run_available(streams.files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")), 120)
    assert run() == "succeeded"
    df.filter("event_id >= 100").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == "succeeded" and run() == "succeeded"
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_repeated_keys_within_the_watermark(spark, tmp_path):
    df = _events(spark).unionByName(_events(spark).limit(50))
    df.write.parquet(str(tmp_path / "in"))
    once = streams.new_only(streams.files(spark, str(tmp_path / "in"), df.schema), "event_id", "ts", "2 days")
    streams.to_memory(once, "once", "append").awaitTermination()
    assert spark.table("once").count() == 400
