from datetime import date

import pytest
from pyspark.sql import functions as F

from spindle.functions import scalars
from spindle.functions import text as tx
from spindle.operators import batch, dsl, quality, registry, rules, stats
from spindle.operators import relational as rel
from spindle import catalog, schemas


def D(s):
    return date.fromisoformat(s)


def test_range_collapse_modes(spark):
    rows = [("k", D("2020-01-01"), D("2020-02-28")), ("k", D("2020-02-29"), D("2020-04-30")), ("k", D("2020-06-01"), D("2020-07-31")), ("k", D("2020-08-01"), D("2020-09-30"))]
    df = spark.createDataFrame(rows, "g string, a date, b date")
    islands = sorted(tuple(r)[1:] for r in rel.collapse_ranges(df, "g", "a", "b").collect())
    assert islands == [(D("2020-01-01"), D("2020-04-30")), (D("2020-06-01"), D("2020-09-30"))]
    quirk = sorted((r.a, r.b) for r in rel.collapse_ranges(df, "g", "a", "b", mode="reference").collect())
    assert quirk == [(D("2020-01-01"), D("2020-09-30")), (D("2020-06-01"), D("2020-07-31"))]


def test_open_ranges_stay_open(spark):
    df = spark.createDataFrame([("k", D("2020-01-01"), D("2020-02-01")), ("k", D("2020-01-15"), None)], "g string, a date, b date")
    assert [tuple(r) for r in rel.collapse_ranges(df, "g", "a", "b").collect()] == [("k", D("2020-01-01"), None)]


def test_interval_join_is_closed(spark):
    left = spark.createDataFrame([("x", D(d)) for d in ("2019-12-31", "2020-01-01", "2020-06-30", "2020-07-01")], "k string, at date")
    right = spark.createDataFrame([("x", D("2020-01-01"), D("2020-06-30"), 1), ("x", D("2021-01-01"), None, 2)], "k string, s date, e date, id int")
    got = rel.interval_join(left, right, ["k"], "at", "s", "e")
    assert sorted(r["at"] for r in got.collect()) == [D("2020-01-01"), D("2020-06-30")]
    with pytest.raises(ValueError):
        rel.interval_join(left, right, [], "at", "s", "e")


def test_range_join_without_key(spark):
    points = spark.createDataFrame([(D(d),) for d in ("2020-01-31", "2020-02-01", "2020-05-05")], "at date")
    ranges = spark.createDataFrame([(D("2020-01-15"), D("2020-03-15"), 1)], "s date, e date, id int")
    joined = rel.range_join(points, ranges, "at", "s", "e")
    assert joined.count() == 2
    assert "NestedLoop" not in joined._jdf.queryExecution().toString()


def test_keep_needs_an_order(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, o int, v string")
    with pytest.raises(ValueError):
        rel.dedupe_keep(df, "k", [])
    assert rel.dedupe_keep(df, "k", "o").first().v == "b" and rel.dedupe_keep(df, "k", "o", "first").first().v == "a"
    assert rel.latest_per_key(df, "k", "o", "v").first().v == "b"


def test_left_join_conserves_rows(spark):
    a = spark.range(10).withColumnRenamed("id", "k")
    got = quality.join_audit(a, spark.createDataFrame([(1,), (1,), (2,)], "k long"), ["k"]).first()
    assert tuple(got) == (10, 11, 8, 2)


def test_date_chunks_keep_the_last_day():
    assert rel.date_chunks("2020-01-01", "2020-01-11", 10) == [("2020-01-01", "2020-01-10"), ("2020-01-11", "2020-01-11")]


def test_policy():
    with pytest.raises(ValueError, match="consol"):
        rel.POLICIES["fundamentals"].check({"indfmt": "INDL", "datafmt": "STD", "popsrc": "D"})


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted(tuple(r) for r in rel.last_wins([a, b], "k").collect()) == [(1, "y"), (2, "z")]
    good, bad = rel.split_by(spark.createDataFrame([(1,), (None,), (5,)], "x int"), F.col("x") > 2)
    assert good.count() == 1 and bad.count() == 2


def test_hand_computed_statistics(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 10)], "g string, x double")
    assert df.agg(F.median("x")).first()[0] == 2.5
    assert stats.quantiles(df, ["g"], "x", 0.3).first().p30 == pytest.approx(1.9)
    peers = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert peers.agg(stats.percentile_below(peers, 3, "x")).first()[0] == 50.0


def test_regression_finds_the_known_model(spark):
    from spindle.sources import files

    fit = {r["term"]: r for r in stats.ols(files.synthetic(spark, 20_000), "y", ["x1", "x2", "treatment"])}
    for term, truth in {"(intercept)": 2.5, "x1": 0.8, "x2": 1.2, "treatment": 0.5}.items():
        assert fit[term]["low"] - 0.01 <= truth <= fit[term]["high"] + 0.01
    panel = spark.range(400).select((F.col("id") % 8).alias("g"), (F.col("id") / 10).alias("x")).withColumn("y", 3 * F.col("x") + 100 * F.col("g"))
    assert stats.fixed_effects(panel, "g", "y", ["x"])[0]["estimate"] == pytest.approx(3)
    q = stats.quantile_regression(panel, "g", "y", ["x"])
    assert all(abs(r.estimate - 3) < 1e-3 for r in q.filter("term = 'x'").collect())
    gap = stats.train_validation_gap(files.synthetic(spark, 5000), "y", ["x1", "x2", "treatment"], seed=1)
    assert abs(gap["gap"]) < 0.1 and gap["train"] > 0.8


def test_fingerprints_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "b")], "a int, b string")
    assert stats.content_hash(df).first() == stats.content_hash(df.orderBy(F.col("a").desc()).repartition(3)).first()
    assert stats.duplicate_count(df).first()[0] == 1
    assert stats.duplicate_count(df.limit(0)).first()[0] == 0
    assert tuple(stats.null_counts(df).first()) == (0, 2)
    assert set(quality.profile(df)) >= {"dtypes", "shape", "describe", "nulls", "duplicates"}


def test_contracts(spark):
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert schemas.nan_to_null(df).first().b is None
    with pytest.raises(ValueError):
        schemas.assert_contract(df, schemas.T.StructType.fromDDL("c int"))
    with pytest.warns(UserWarning):
        schemas.assert_contract(df, schemas.T.StructType.fromDDL("a long"))
    with pytest.raises(TypeError):
        schemas.assert_contract(df, schemas.T.StructType.fromDDL("a long"), "raise")
    assert schemas.flat_metadata_errors(schemas.T.StructType.fromDDL("a int, b struct<x:int>, c array<int>")) == ["b", "c"]


def test_catalog(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    assert catalog.sql(spark, "SELECT * FROM {t} WHERE k < :n", {"n": 3}, t=df).count() == 3
    assert catalog.sql(spark, "SELECT * FROM {t} WHERE k = ?", [4], t=df).first().k == 4
    hostile = catalog.sql(spark, "SELECT * FROM {t} WHERE cast(k AS string) = :v", {"v": "1' OR '1'='1"}, t=df)
    assert hostile.count() == 0
    assert [len(c) for c in catalog.rows_in_chunks(df, 10)] == [10, 10, 5]
    df.createOrReplaceTempView("there")
    assert catalog.accessible(spark, "there") and not catalog.accessible(spark, "not_there")
    assert "default" in catalog.databases(spark)


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.pad_cik(F.lit("719739"))) == "0000719739" and one(scalars.pad_cik(F.lit("12345678901"))) == "12345678901"
    assert one(scalars.stem(F.lit("a/b/c.tar.gz"))) == "c.tar" and one(scalars.suffix(F.lit("a/B.PDF"))) == ".pdf"
    assert [one(scalars.mime_type(F.lit("x.zzz"), u)) for u in ("batch", "icon")] == ["application/octet-stream", "image/png"]
    assert [one(scalars.score_band(F.lit(x))) for x in (24.9, 25, 50, 75)] == ["poor", "satisfactory", "good", "excellent"]
    assert one(scalars.fiscal_period(F.lit("FQ-4"))).offset == -4 and one(scalars.fiscal_period(F.lit("zz"))) is None
    assert one(scalars.isbn_valid(F.lit("0-306-40615-2"))) and not one(scalars.isbn_valid(F.lit("0-306-40615-3")))
    for text, want in (('{"a": 1}', 1), ('```json\n{"a": 1}\n```', 1), ('```\n{"a": 1}\n```', 1), ('so: {"a": 1} ok', 1), ("junk", None)):
        assert one(F.try_variant_get(scalars.salvage_json(F.lit(text)), "$.a", "int")) == want
    assert one(F.to_json(scalars.salvage_json(F.lit("list [1, 2] end")))) == "[1,2]"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    filing = F.lit("ITEM 1. Business we sell\nthings Item 1A Risk Factors many Item 1B")
    assert one(tx.section(filing, "Item 1")) == "we sell\nthings" and one(tx.section(filing, "Item 8")) is None
    assert one(tx.similarity(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)
    assert one(tx.smart_quotes(F.lit("say \"hi\" it's"))) == "say “hi” it’s"
    assert [tuple(r) for r in one(tx.changed_lines(F.lit("a\nb"), F.lit("a\nc")))] == [(2, "b", "c")]
    assert one(tx.mask_secret(F.lit("abcdefghijklmnop"))) == "abcd...mnop" and one(tx.mask_secret(F.lit("short"))) == "***"
    assert tuple(one(tx.env_line(F.lit("A='x=y'")))) == ("A", "x=y") and one(tx.env_line(F.lit("# A=1"))) is None
    doc = F.lit("---\nname: n1\ncost: cheap\n---\nbody\n---\nmore")
    assert one(tx.front_field(doc, "name")) == "n1" and one(tx.strip_front_matter(doc)) == "body\n---\nmore"
    once = tx.replace_footer(F.lit("text"), " v1", "-- ")
    assert one(tx.replace_footer(once, " v1", "-- ")) == one(once)
    assert one(rules.suggest(F.lit("It delves into law."))) == "It examines law."
    assert one(rules.decisive(F.lit("see turn0search1"))) and not one(rules.decisive(F.lit("plain")))
    assert one(rules.title_case_headings(F.lit("# All Caps Here\n## not so\ntext"))) == 0.5


def test_dsl(spark):
    df = spark.createDataFrame([(1, 6e9, "XNYS", 10.0), (2, 4e9, "XNAS", 10.0), (3, 6e9, "XLON", 30.0)], "id int, cap double, exch string, pe double")
    s = dsl.Screen('U(IN(Equity(active))), /*by size*/ TR.Worth(Scale=6)>=5000, IN(TR.Place,"XNYS","XNAS"), TR.Multiple<=20, CURN=EUR')
    assert s.universe == ["active"] and s.currency == "EUR"
    got = df.filter(s.condition({"TR.Worth": "cap", "TR.Place": "exch", "TR.Multiple": "pe"}))
    assert [r.id for r in got.collect()] == [1]
    for bad in ("TR.X>=", "IN(", "TR.X ? 3"):
        with pytest.raises(ValueError):
            dsl.Screen(bad)
    news = spark.createDataFrame([(1, "IBM.N", "LEN", "merger"), (2, "MSFT.O", "LEN", "profit"), (3, "IBM.N", "LDE", "merger")], "id int, r string, l string, t string")
    pick = lambda q: [x.id for x in news.filter(dsl.news_query(q, {"R": F.col("r"), "Language": F.col("l")}, F.col("t"))).collect()]
    assert pick("(R:IBM.N OR R:MSFT.O) AND Language:LEN") == [1, 2] and pick("R:IBM.N AND NOT Language:LEN") == [3] and pick("merger") == [1, 3]


def test_request_lines(spark):
    good = '{"request":{"contents":[{"role":"user","parts":[{"fileData":{"fileUri":"gs://b/x"}}]}]},"metadata":{"request_id":"a"}}'
    lines = [good, "", "{bad", "{}", '{"request":{}}', good.replace("user", "model").replace('"a"', '"b"'), good.replace("gs://", "http://").replace('"a"', '"c"'), good, '{"request":{"contents":[{"role":"user","parts":[]}]}}', '{"request":{"contents":[]},"metadata":{"request_id":"d"}}']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, value string")
    got = {(r.line_no, r.severity, r.message) for r in quality.validate_requests(df).collect()}
    assert got == {(2, "warning", "empty line"), (3, "error", "invalid JSON"), (4, "error", "missing request"), (5, "error", "missing contents"), (6, "error", "first role is not user"), (7, "error", "fileUri is not gs://"), (8, "error", "duplicate request_id"), (9, "warning", "missing request_id"), (10, "error", "empty contents")}
    assert {s for n, s, _ in ((r.line_no, r.severity, r.message) for r in quality.validate_requests(df, strict=True).collect()) if n in (2, 9)} == {"error"}


def test_batch(spark):
    files = spark.createDataFrame([("gs://b/d/one.pdf", b"1"), ("gs://b/d/two.png", b"2")], "uri string, content binary")
    lines = batch.requests(files, 'Say "hi"')
    assert quality.validate_requests(lines.select(F.monotonically_increasing_id().alias("line_no"), F.col("line").alias("value"))).count() == 0
    assert lines.select("request_id").collect() == batch.requests(files, 'Say "hi"').select("request_id").collect()
    manifest = spark.createDataFrame([("a", "submitted", 1), ("b", "completed", 1)], "request_id string, status string, updated_at int")
    after = batch.upsert(manifest, spark.createDataFrame([("a", "completed", 2)], manifest.schema))
    assert batch.pending(spark.createDataFrame([("a",), ("c",)], "request_id string"), after).collect()[0][0] == "c"
    answered = batch.call_model(files, lambda: lambda k, c: f"{k}!" if c == b"1" else 1 / 0, "uri", "content")
    assert {(r.uri[-7:], r.answer is None, r.error is None) for r in answered.collect()} == {("one.pdf", False, True), ("two.png", True, False)}
    done = batch.retry(files, lambda f: batch.call_model(f, lambda: lambda k, c: k, "uri", "content"))
    assert done.count() == 2


def test_registry(spark):
    files = spark.createDataFrame([("a/SKILL.md", "---\nname: x\ncost: CHEAP\n---\n"), ("b/SKILL.md", "---\nname: x\ncost: FREE\n---\n"), ("c/SKILL.md", "no front"), ("d/e/f/g/SKILL.md", "---\nname: y\ncost: EXPENSIVE\n---\n")], "path string, value string")
    skills = registry.load(files)
    assert {(r.name, r.cost) for r in skills.collect()} == {("x", "FREE"), ("y", "EXPENSIVE")}
    assert registry.shallow(files).count() == 3
    assert [r.name for r in registry.catalogue_rows(skills).collect()] == ["x", "y"]
    code = "def _(a):\n    b = a\n    return b,\n\ndef _(b):\n    a = b\n    return a,\n"
    cells = registry.cell_map(spark.createDataFrame([("n.py", code)], "path string, value string"))
    assert cells.count() == 2 and registry.graph_faults(cells).count() == 0
    assert registry.has_cycle([(r.source, r.target) for r in registry.edges(cells).collect()])


def test_notebooks(spark):
    import json

    nb = json.dumps({"cells": [{"cell_type": "code", "execution_count": 1, "outputs": [{"output_type": "error", "ename": "E"}]}, {"cell_type": "code", "execution_count": None, "outputs": []}, {"cell_type": "markdown"}]})
    got = [tuple(r)[1:] for r in quality.notebook_cells(spark.createDataFrame([("n", nb)], "path string, value string")).collect()]
    assert got == [(0, "code", 1, True), (1, "code", 0, False), (2, "markdown", 0, False)]


def test_fuzzy_names_are_all_matched(spark, tmp_path):
    from difflib import SequenceMatcher

    from spindle.plans import relational as plans

    words = ("blue", "Blue", "old", "cold"), ("ring", "rings", "bolt", "plate", "Bolt x")
    parts = [(n, f"{a} {b}") for n, (a, b) in enumerate([(a, b) for a in words[0] for b in words[1]] * 3, 1)] + [(90, None), (91, "  ring"), (92, "")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.name, r.p_partkey, round(r.ratio, 9)) for r in plans.fuzzy_names(spark, str(tmp_path)).collect())
    want = []
    for name in {n for _, n in parts if n is not None}:
        for key, other in parts:
            if other is not None and name.upper().split()[:1] == other.upper().split()[:1]:
                ratio = SequenceMatcher(None, name.upper(), other.upper()).ratio()
                if ratio >= 0.7:
                    want.append((name, key, round(ratio, 9)))
    assert got == sorted(want) and max(k for _, k, _ in got) > 20


def test_event_windows_of_all_days(spark, tmp_path):
    from datetime import datetime, timedelta

    from spindle.plans import relational as plans

    events = [(n, datetime(2024, 1, 27) + timedelta(days=n % 9 + n % 2, hours=n)) for n in range(1, 60)] + [(60, None)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    days = {t.date() for _, t in events if t}
    want = sorted((str(d), n) for d in days for n, t in events if t and d <= t.date() <= d + timedelta(days=3))
    got = sorted((str(r.day), r.event_id) for r in plans.event_windows(spark, str(tmp_path)).collect())
    assert got == want and {d for d, _ in got} == set(map(str, days))


def test_sections_hold_whole_texts(spark, tmp_path):
    from spindle.plans import documents as plans

    docs = [(1, "word " * 500 + "end"), (2, "short"), (3, None), (4, "a\nb " * 30 + "last")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.section for r in plans.section_extract(spark, str(tmp_path)).collect()}
    assert got == dict(docs)
