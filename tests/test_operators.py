"""Operators against plain versions, and what their odd inputs give."""

from datetime import date
from difflib import SequenceMatcher
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle import session as sessions
from spindle.functions import scalars
from spindle.functions import text as tx
from spindle.operators import batch, nested, quality, registry, report, rules, stats
from spindle.operators import relational as rel
from spindle.sources import vendor


def test_fuzzy_match_is_that_of_all_pairs_of_a_block(spark):
    left = ["Acme Steel Corp", "acme steel", "Beta Bank", "Gamma", None, "", "Beta"]
    right = ["ACME STEEL CORPORATION", "Acme Foods", "beta bank na", "Gamma Ray Inc", "Delta", None, "Beta"]
    block = lambda x: x.upper().strip().split()[0] if x.strip() else ""
    want = {(a, b) for a in left for b in right if a is not None and b is not None and block(a) == block(b) and SequenceMatcher(None, a.upper(), b.upper()).ratio() >= 0.6}
    got = rel.fuzzy_match(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "company string"), threshold=0.6).collect()
    assert {(r.name, r.company) for r in got} == want and len(want) >= 3
    assert all(abs(r.ratio - SequenceMatcher(None, r.name.upper(), r.company.upper()).ratio()) < 1e-12 for r in got)


def test_median_regression_minimises_absolute_errors(spark):
    r = np.random.Generator(np.random.PCG64(5))
    x = r.uniform(0, 10, 300)
    y = 3 + 2 * x + r.standard_t(2, 300)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    fit = {q.term: q.estimate for q in stats.quantile_regression(df, "g", "y", ["x"]).collect()}
    loss = lambda a, b: np.abs(y - a - b * x).sum()
    best = loss(fit["(intercept)"], fit["x"])
    assert all(best <= loss(fit["(intercept)"] + i, fit["x"] + j) + 1e-6 for i in (-0.05, 0, 0.05) for j in (-0.02, 0, 0.02))


@pytest.mark.parametrize("few", [0, 40_000])
def test_quantiles_are_exact(spark, monkeypatch, few):
    """By the sketch's bounds in the large group, by the extremes in small ones."""
    monkeypatch.setattr(stats, "FEW", min(few, 3000) or 3000)
    monkeypatch.setattr(stats, "ACCURACY", 2000 if few else 200)
    r = np.random.Generator(np.random.PCG64(6))
    rows = [("a", float(v)) for v in r.standard_normal(5000)] + [("b", float(v)) for v in r.integers(0, 4, 999)] + [("c", 7.5)] + [("d", None)] * 3 + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    points = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {q.g: q for q in stats.quantiles(df, ["g"], "x", *points).collect()}
    for g in ("a", "b", "c", None):
        values = [x for k, x in rows if k == g and x is not None]
        for p in points:
            assert abs(got[g][f"p{round(p * 100)}"] - np.quantile(values, p)) < 1e-9, (g, p)
    assert got["d"].p50 is None and len(got) == 5
    assert abs(stats.median(df, "x").first().x - np.median([x for _, x in rows if x is not None])) < 1e-9
    assert stats.median(df.filter("g = 'zz'"), "x").collect() in ([], [(None,)])


def test_numbers_and_chunks(spark):
    rows = [(5, "b"), (5, "a"), (1, "z"), (None, "n"), (9, "q")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    for ranges in (2, 200):
        got = {r.t: r.number for r in rel.numbered(df, "k", "t", ranges=ranges).collect()}
        assert got == {"n": 0, "z": 1, "a": 2, "b": 3, "q": 4}
    days = spark.createDataFrame([(date(2024, 1, 1 + i % 28), i) for i in range(200)], "d date, i int")
    got = sorted((r.d, r.i, r.number) for r in rel.numbered(days, "d", "i").collect())
    assert [n for *_, n in got] == list(range(200))
    assert rel.numbered(df.limit(0), "k").count() == 0
    assert {r.job for r in batch.jobs(spark.range(25).toDF("id"), "id", 10).collect()} == {0, 1, 2}


def test_pairs_of_large_groups(spark):
    rows = [(i, "big") for i in range(40)] + [(1, "s"), (2, "s"), (2, "s"), (3, "t")]
    df = spark.createDataFrame(rows, "item int, grp string").repartition(3)
    want = {(a, b): 1 + ((a, b) == (1, 2)) for a in range(40) for b in range(a + 1, 40)}
    for most in (7, 1000):
        assert {(r.a, r.b): r.shared for r in rel.pair_counts(df, "item", "grp", most).collect()} == want


def test_range_join_by_any_width(spark):
    day = lambda n: date.fromordinal(738000 + n)
    points = [(i, day(i * 3)) for i in range(40)]
    ranges = [(1, day(0), day(0)), (2, day(5), day(95)), (3, day(50), day(40)), (4, day(117), day(400))]
    want = {(i, k) for i, p in points for k, a, b in ranges if a <= p <= b}
    a, b = spark.createDataFrame(points, "i int, at date"), spark.createDataFrame(ranges, "k int, a date, b date")
    for width in (None, 1, 500):
        assert {(r.i, r.k) for r in rel.range_join(a, b, "at", "a", "b", width).collect()} == want


def test_smart_quotes_spare_code(spark):
    cases = {
        '"Hi," she said (\'so\') don\'t': "“Hi,” she said (‘so’) don’t",
        'say "x" and `a "b"` end': "say “x” and `a \"b\"` end",
        '```\nprint("a")\n```\n"out"': '```\nprint("a")\n```\n“out”',
        '<code class="k">"a"</code> "b"': '<code class="k">"a"</code> “b”',
        '``` "open to the end': '``` "open to the end',
        "a ` 'lone' tick": "a ` ‘lone’ tick",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.q for r in df.select("t", tx.smart_quotes(F.col("t")).alias("q")).collect()}
    assert got == {**cases, None: None}
    diff = df.select("t", F.inline(tx.changed_lines(F.col("t"), tx.smart_quotes(F.col("t"))))).collect()
    assert {(r.t, r.line) for r in diff if r.t and r.t.startswith("```\n")} == {('```\nprint("a")\n```\n"out"', 4)}


def test_numbers_as_text_and_identifiers(spark):
    df = spark.createDataFrame([(1234567.125, 0.05), (-0.5, -12.25), (None, None)], "a double, b double")
    got = [tuple(r) for r in df.select(scalars.thousands(F.col("a")), scalars.signed(F.col("b"))).collect()]
    assert got == [("1,234,567.12", "+0.0"), ("-0.50", "-12.2"), (None, None)]
    text = "ISBN 978-0-306-40615-7, 0-306-40615-2 or 080442957X; not 97803064061579 nor 12345; doi:10.1000/xyz-1(2), 10.1/no"
    one = spark.createDataFrame([(text,)], "t string").select(scalars.isbns(F.col("t")).alias("i"), scalars.dois(F.col("t")).alias("d")).first()
    assert one.i == ["978-0-306-40615-7", "0-306-40615-2", "080442957X"] and one.d == ["10.1000/xyz-1(2)"]
    names = spark.range(1).select(scalars.document_names(F.lit("0000-1"), F.lit("ABC"), F.lit(2020)).alias("n"), scalars.has_suffix(F.lit("a.CSV"), ".csv", ".txt").alias("s"), tx.first_url(F.lit("see <https://a.b/c?d=1> or http://x")).alias("u")).first()
    assert names.n[0] == "0000-1.txt" and "abc-20201231.htm" in names.n and names.s and names.u == "https://a.b/c?d=1"


def test_isbns_have_right_check_digits(spark):
    def right(code):
        d = [10 if c in "Xx" else int(c) for c in code.replace("-", "")]
        return sum(v * w for v, w in zip(d, range(10, 0, -1))) % 11 == 0 if len(d) == 10 else sum(v * (1, 3)[i % 2] for i, v in enumerate(d)) % 10 == 0

    codes = ["978-0-306-40615-7", "978-0-306-40615-8", "080442957X", "0804429571", "0-306-40615-2", "9780470521571"]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select("c", scalars.isbn_valid(F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == [right(c) for c in codes]


def test_required_outputs(spark):
    df = spark.range(20).withColumn("t", F.lit("x"))
    out = quality.audited("filter", df.filter("id < 5"), df)
    assert out == {"before": 20, "after": 5, "pct_removed": 75.0}
    assert set(quality.audited("load", df)) == {"shape", "dtypes", "head"}
    assert quality.audited("join", df, df)["nulls"].first().id == 0
    with pytest.raises(ValueError, match="metrics"):
        quality.audited("fit", df)
    assert quality.audited("predict", df, distribution=[1])["distribution"] == [1]
    assert quality.assert_not_empty(df) is df
    with pytest.raises(ValueError, match="no rows"):
        quality.assert_not_empty(df.limit(0))
    shown = quality.profile(df)
    assert shown["head"].count() == 5 and {r.t: r.n for r in shown["value_counts"]["t"].collect()} == {"x": 20}


def test_assert_requests(spark):
    good = '{"request":{"contents":[{"role":"user","parts":[]}]},"metadata":{"request_id":"a"}}'
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "line_no long, value string")
    quality.assert_requests(lines(good, ""))
    with pytest.raises(ValueError, match="line 1: invalid JSON"):
        quality.assert_requests(lines(good, "{"))
    many = quality.validate_requests(lines(*[""] * 500, good, good)).collect()
    assert sum(r.message == "duplicate request_id" for r in many) == 1 and sum(r.message == "empty line" for r in many) == 500


def test_report():
    summary = [{"name": "A", "total_value": 3e6, "total_shares": 10, "transactions": 2}, {"name": "B", "total_value": 1234567890.0, "total_shares": 5, "transactions": 9}]
    compared = [{"measure": m, "focal_value": 1.0, "peer_median": 2.0, "pct_over_median": o, "percentile": p} for m, o, p in (("value", 12.34, 76.0), ("n", None, 75.0), ("shares", -3.0, 50.0))]
    months = [{"month": f"2020-0{i}", "value": i * 1e6, "shares": 1500.0, "n": i} for i in range(1, 8)]
    text = report.render("DISPOSALS", "A", summary, compared, months, watched=["B"])
    assert "   1. B: $1,234.57M\n   2. A: $3.00M <" in text and "vs median: +12.3%" in text and "vs median: n/a" in text
    assert "76th percentile for value - significantly higher" in text and "75th percentile for n - above median" in text and "50th percentile for shares - below median" in text
    assert "2020-07: $7.00M (1.5K shares, 7 txns)" in text and "2020-02" not in text and "  - B: $1234.57M (9 transactions)" in text
    assert "COMPARISON" not in report.render("T", "A", [], [], [])
    assert report.level(75.01).startswith("significantly") and report.level(0) == "below median"


def test_registry_lookups_and_plan_checks(spark):
    skills = spark.createDataFrame([("a", "x", "FREE", None), ("b", "x", "CHEAP", "a")], "name string, category string, cost string, parent_skill string")
    assert [r.name for r in registry.lookup(skills, category="x", cost="CHEAP").collect()] == ["b"] and registry.lookup(skills, parent="a").count() == 1
    policy = rel.FilterPolicy(cost="FREE")
    policy.check_plan(skills.filter("cost = 'FREE' and name = 'a'"))
    for bad in (skills, skills.filter("cost = 'FREEDOM'"), skills.filter("category = 'FREE'")):
        with pytest.raises(ValueError, match="does not filter"):
            policy.check_plan(bad)
    assert rel.snake_case(spark.createDataFrame([(1, 2)], "`Total Value` int, fooBar int")).columns == ["total_value", "foo_bar"]
    with pytest.raises(ValueError, match="clash"):
        rel.snake_case(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_damaged_vendor_documents(spark):
    docs = spark.createDataFrame([(1, "{"), (2, '{"isError":true,"results":[{"holdings":[{"name":"x"}]}]}'), (3, '{"results":[{"holdings":[{"name":"y","percent":2.5}]}]}'), (4, None), (5, '{"results":[]}')], "fund long, json string")
    assert [(r.fund, r.name, r.percent) for r in nested.fund_module(docs, "TTH", "name:string,percent:double").collect()] == [(3, "y", 2.5)]
    assert nested.holdings(docs).count() == 0 and nested.available_dates(docs).count() == 0
    findings = spark.createDataFrame([("puffery",), ("perfect_grammar",), (None,)], "rule string")
    assert {r.rule for r in rules.indicators(findings).collect()} == {"puffery", None}


def test_connections_are_tried_again():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("gone")
        return "ok"

    assert vendor.with_reconnects(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):  # an error of the query passes at once
        vendor.with_reconnects(lambda: (_ for _ in ()).throw(ValueError("query")), sleep=waits.append)
    with pytest.raises(ConnectionError):
        vendor.with_reconnects(lambda: (_ for _ in ()).throw(ConnectionError()), sleep=lambda s: None)
    assert sessions.pool_size({}) == (1, 5) and sessions.pool_size({"SPINDLE_POOL_MIN": "2", "SPINDLE_POOL_MAX": "3"}) == (2, 3)
    with pytest.raises(ValueError):
        sessions.pool_size({"SPINDLE_POOL_MIN": "9"})


def test_waits_and_sizes(spark):
    from spindle import catalog

    assert vendor.delays(4) == [1.0, 2.0, 4.0] and vendor.delays(5, 30, 2, 100) == [30, 60, 100, 100] and vendor.delays(1) == []
    assert 0 < catalog.plan_bytes(spark.range(10)) < catalog.plan_bytes(spark.range(1000))
    rows = spark.createDataFrame([("A", "x" * 13), ("B", ""), ("C", None), ("D", "short")], "name string, value string")
    assert {(r.name, r.shown) for r in registry.settings(rows, ["A", "B", "C", "D"]).collect()} == {("A", "xxxx...xxxx"), ("D", "***")}
    assert spark.range(1).select(registry.behind(F.lit(None).cast("string")).alias("b")).first().b is False


def test_failed_rows_run_again(spark):
    seen = SimpleNamespace(turn=0)

    def run(df):
        seen.turn += 1
        return df.select("id", F.lit("a").alias("answer"), F.when(F.col("id") % 3 >= seen.turn, F.lit("busy")).alias("error"))

    done = batch.retry(spark.range(6).toDF("id"), run, 2)
    assert {r.id: r.error for r in done.collect()} == {0: None, 1: None, 2: "busy", 3: None, 4: None, 5: "busy"}
    seen.turn = 0
    assert batch.retry(spark.range(6).toDF("id"), run, 5).filter("error is null").count() == 6
