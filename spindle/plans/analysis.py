"""The flagship analysis, aggregates, statistics and windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table, tables
from ..operators import quality, stats
from ..operators import relational as rel
from .registry import exact_mean, exact_sum, query

#: Disposals restated: returned or shipped lines of the last years, by customer; the focal one is customer 1.
_DISPOSALS = """d AS (SELECT l.*, o.o_custkey, o.o_orderdate, c.c_name, c.c_mktsegment, l.l_quantity * l.l_extendedprice AS value,
 CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Executive Officer' WHEN o.o_orderpriority = '2-HIGH' THEN 'Senior Officer' WHEN o.o_orderstatus = 'F' THEN 'Director' ELSE 'Other Insider' END AS role
 FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
 WHERE o.o_orderdate >= TIMESTAMP '1994-01-01' AND o.o_orderdate < TIMESTAMP '1998-01-01' AND l.l_returnflag IN ('R', 'N') AND l.l_quantity IS NOT NULL AND l.l_quantity <> 0),
e AS (SELECT * FROM d WHERE regexp_matches(role, '(?i)executive|senior|director')),
s AS (SELECT o_custkey, c_name, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_value, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS total_shares, count(*) AS transactions, count(DISTINCT l_suppkey) AS insiders FROM e GROUP BY 1, 2)"""


def disposals(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their order and customer, filtered, with role and value: one plan, not a query for each customer."""
    l, o, c = tables(spark, d, "lineitem", "orders", "customer")
    l = l.filter(F.col("l_returnflag").isin("R", "N") & F.col("l_quantity").isNotNull() & (F.col("l_quantity") != 0))
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("1994-01-01", "1998-01-01"))
    o = o.filter((F.col("o_orderdate") >= since) & (F.col("o_orderdate") < until))
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "Executive Officer").when(F.col("o_orderpriority") == "2-HIGH", "Senior Officer").when(F.col("o_orderstatus") == "F", "Director").otherwise("Other Insider")
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    rows = rows.withColumn("role", role).filter(F.col("role").rlike("(?i)executive|senior|director"))
    return rows.withColumn("value", F.col("l_quantity") * F.col("l_extendedprice"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return disposals(spark, d).groupBy("o_custkey", "c_name").agg(exact_sum("value").alias("total_value"), exact_sum("l_quantity").alias("total_shares"), F.count("*").alias("transactions"), F.count_distinct("l_suppkey").alias("insiders"))


@query(f"WITH {_DISPOSALS} SELECT *, o_custkey = 1 AS is_focal FROM s")
def disposal_summary(spark, d):
    return summary(spark, d).withColumn("is_focal", F.col("o_custkey") == 1)


@query(f"WITH {_DISPOSALS} SELECT strftime(l_shipdate, '%Y-%m') AS month, role, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value, count(*) AS n FROM e GROUP BY 1, 2")
def disposal_timeline(spark, d):
    return disposals(spark, d).groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "role").agg(exact_sum("value").alias("value"), F.count("*").alias("n"))


@query(f"WITH {_DISPOSALS}, m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, role, count(*) AS n FROM e GROUP BY 1, 2) SELECT role, CAST(sum(n) AS BIGINT) AS n, count(*) AS months FROM m WHERE month >= '1996-01' GROUP BY role")
def reaggregate(spark, d):
    m = disposals(spark, d).groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "role").agg(F.count("*").alias("n"))
    return m.filter("month >= '1996-01'").groupBy("role").agg(F.sum("n").alias("n"), F.count("*").alias("months"))


@query(f"""WITH {_DISPOSALS}, f AS (SELECT max(total_value) AS f, max(transactions)::DOUBLE AS t FROM s WHERE o_custkey = (SELECT min(o_custkey) FROM s)),
 p AS (SELECT 'total_value' AS measure, total_value AS x, f.f AS focal_value FROM s, f WHERE o_custkey <> (SELECT min(o_custkey) FROM s) UNION ALL SELECT 'transactions', transactions, f.t FROM s, f WHERE o_custkey <> (SELECT min(o_custkey) FROM s))
 SELECT measure, focal_value, median(x) AS peer_median, round(avg((x < focal_value)::INT) * 100, 6) AS percentile, round((focal_value - median(x)) / nullif(median(x), 0) * 100, 6) AS pct_over_median FROM p GROUP BY 1, 2""")
def focal_vs_peers(spark, d):
    s = summary(spark, d)
    first = s.agg(F.min("o_custkey").alias("first"))
    s = s.join(F.broadcast(first))
    out = stats.focal_vs_peers(s, F.col("o_custkey") == F.col("first"), "total_value", "transactions")
    return out.select("measure", "focal_value", "peer_median", F.round("percentile", 6).alias("percentile"), F.round("pct_over_median", 6).alias("pct_over_median"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most, count(*) AS n, round(CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1, 2")
def group_basics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(exact_sum("l_quantity").alias("sum_qty"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.count("*").alias("n"), exact_mean("l_discount").alias("mean_discount"))


@query("SELECT event_type, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(*) AS n FROM events GROUP BY 1")
def mean_sd_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"), F.count("*").alias("n"))


@query("SELECT median(l_extendedprice) AS median_price, median(l_quantity) AS median_quantity FROM lineitem")
def medians(spark, d):
    return stats.median(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").toDF("median_price", "median_quantity")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS jdate, median(o_totalprice) AS size_median FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", dates=('jdate',))
def breakpoint_medians(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.trunc("o_orderdate", "month").alias("jdate"), "o_totalprice")
    return stats.quantiles(o, ["jdate"], "o_totalprice", 0.5).withColumnRenamed("p50", "size_median")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.3), 6) AS p30, round(quantile_cont(o_totalprice, 0.7), 6) AS p70 FROM orders GROUP BY 1")
def breakpoints_p30_p70(spark, d):
    q = stats.quantiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.3, 0.7)
    return q.select("o_orderpriority", F.round("p30", 6).alias("p30"), F.round("p70", 6).alias("p70"))


@query("SELECT c_mktsegment, round(avg(c_custkey), 4) AS c_custkey, round(avg(c_nationkey), 4) AS c_nationkey, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS c_acctbal FROM customer GROUP BY 1")
def sector_means(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy("c_mktsegment").agg(*[F.round(exact_sum(n) / F.count(n), 4).alias(n) for n in stats.numeric(c)])


@query("SELECT user_id, max(CAST(ts AS DATE)) AS last_day, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1", dates=('last_day', 'first_day',))
def latest_date(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("date")).alias("last_day"), F.min(F.col("ts").cast("date")).alias("first_day"))


@query("SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem GROUP BY 1")
def group_correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"))


@query("""SELECT 'l_quantity' AS "column", count(l_quantity) AS count, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS max FROM lineitem""")
def describe_quantity(spark, d):
    out = stats.describe_exact(table(spark, d, "lineitem"), "l_quantity")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT round(avg(p_size), 6) AS p_size_mean, round(stddev_samp(p_size), 4) AS p_size_sd, count(p_size) AS p_size_n, round(avg(p_retailprice), 4) AS p_retailprice_mean, round(stddev_samp(p_retailprice), 4) AS p_retailprice_sd, count(p_retailprice) AS p_retailprice_n FROM part")
def across_numeric(spark, d):
    out = stats.across(table(spark, d, "part"), "p_size", "p_retailprice")
    return out.select(*[F.round(c, 6 if c == "p_size_mean" else 4).alias(c) if not c.endswith("_n") else F.col(c) for c in out.columns])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT count(*) FILTER (nullif(o_orderstatus, 'P') IS NULL) AS status, count(*) FILTER (nullif(o_orderpriority, '5-LOW') IS NULL) AS priority FROM orders")
def null_counts(spark, d):
    return stats.null_counts(table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM (SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) GROUP BY c_nationkey, s)")
def duplicate_rows(spark, d):
    return stats.duplicate_count(table(spark, d, "customer").select("c_nationkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s")))


@query("SELECT count(*) FILTER (json_extract_string(props, '$') IS NOT NULL) AS parsed, count(*) FILTER (value > 50) AS high, count(*) FILTER (NOT value > 50) AS low FROM events")
def conditional_counts(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count_if(F.try_parse_json("props").isNotNull()).alias("parsed"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(~(F.col("value") > 50)).alias("low"))


@query("""SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), o_orderkey, o_custkey, coalesce(nullif(o_orderstatus, 'P'), '-'), CAST(o_orderdate AS DATE), CAST(round(o_totalprice * 100) AS BIGINT))), 1, 15) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM orders""")
def content_fingerprint(spark, d):
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", "o_custkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("-")).alias("status"), F.col("o_orderdate").cast("date").alias("day"), F.round(o.o_totalprice * 100).cast("bigint").alias("cents"))
    return stats.content_hash(rows)


@query("""WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 30)) + 1, 30) AS INT) AS bin, count(*) AS n FROM customer, b GROUP BY 1""")
def histogram_30(spark, d):
    return stats.histogram(table(spark, d, "customer"), "c_acctbal", 30)


@query("SELECT count(*) AS before, count(*) FILTER (o_totalprice > 100000) AS after, round(100.0 * (count(*) - count(*) FILTER (o_totalprice > 100000)) / count(*), 6) AS pct_removed FROM orders")
def filter_audit(spark, d):
    out = quality.filter_audit(table(spark, d, "orders"), F.col("o_totalprice") > 100000)
    return out.withColumn("pct_removed", F.round("pct_removed", 6))


@query("""WITH r AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS left_rows, CAST(sum(coalesce(n, 1)) AS BIGINT) AS joined_rows, count(*) FILTER (n IS NULL) AS unmatched, max(n) AS most_matches FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def join_audit(spark, d):
    c, o = tables(spark, d, "customer", "orders")
    return quality.join_audit(c.withColumnRenamed("c_custkey", "k"), o.withColumnRenamed("o_custkey", "k"), ["k"])


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
 SELECT count(*) FILTER (value IS NULL) AS missing, count(value) - count(DISTINCT value) AS repeated, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers, count(DISTINCT value) AS distinct_values,
 round((avg(power(value - (SELECT avg(value) FROM events), 3))) / power(var_pop(value), 1.5), 4) AS skew FROM events, q""")
def value_issues(spark, d):
    return quality.issues(table(spark, d, "events"), "value").withColumn("skew", F.round("skew", 4))


# Windows


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS customer_total FROM orders")
def rank_and_total(spark, d):
    w = Window.partitionBy("o_custkey")
    rank = F.row_number().over(w.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", rank.alias("rank"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).over(w).cast("double").alias("customer_total"))


@query("SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS before, o_totalprice - lag(o_totalprice) OVER w AS change, first_value(o_totalprice) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_change_first(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = F.lag("o_totalprice").over(w)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", before.alias("before"), (F.col("o_totalprice") - before).alias("change"), F.first("o_totalprice").over(w).alias("first"))


_RANGES = "r AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(60 + o_orderkey % 90 AS INT) AS b FROM orders)"


def _ranges(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.col("o_orderdate").cast("date"))
    return o.select("o_custkey", "a", F.date_add("a", (60 + F.col("o_orderkey") % 90).cast("int")).alias("b")).distinct()


@query(f"""WITH {_RANGES}, m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM r),
 i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT o_custkey, min(a) AS a, max(b) AS b FROM i GROUP BY o_custkey, island""", dates=('a', 'b',))
def range_collapse(spark, d):
    return rel.collapse_ranges(_ranges(spark, d), "o_custkey", "a", "b")


@query("SELECT user_id, CAST(ts AS DATE) AS day, date_diff('day', lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id), CAST(ts AS DATE)) AS gap FROM events", dates=('day',))
def date_gaps(spark, d):
    day = F.col("ts").cast("date")
    gap = F.date_diff(day, F.lag(day).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).cast("long")
    return table(spark, d, "events").select("user_id", day.alias("day"), gap.alias("gap"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def ohlc_1h(spark, d):
    at = F.struct("ts", "event_id")
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type")
    return e.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def snapshot_latest(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


@query("""WITH b AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, d):
    e = table(spark, d, "events").groupBy(F.session_window("ts", "10 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


_FITTED = "term string, estimate double, std_error double"


@query("""WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS q, avg(l_discount) AS c, avg(l_extendedprice) AS y, var_pop(l_quantity) AS qq, var_pop(l_discount) AS cc, covar_pop(l_quantity, l_discount) AS qc,
  covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS cy, var_pop(l_extendedprice) AS yy FROM lineitem),
 b AS (SELECT *, qq * cc - qc * qc AS det, (cc * qy - qc * cy) / (qq * cc - qc * qc) AS bq, (qq * cy - qc * qy) / (qq * cc - qc * qc) AS bc FROM m),
 s AS (SELECT *, n * (yy - bq * qy - bc * cy) / (n - 3) AS v FROM b)
 SELECT '(intercept)' AS term, round(y - bq * q - bc * c, 3) AS estimate, round(sqrt(v / n * (1 + (q * q * cc + c * c * qq - 2 * q * c * qc) / det)), 3) AS std_error FROM s
 UNION ALL SELECT 'l_quantity', round(bq, 3), round(sqrt(v * cc / (n * det)), 3) FROM s UNION ALL SELECT 'l_discount', round(bc, 3), round(sqrt(v * qq / (n * det)), 3) FROM s""")
def least_squares(spark, d):
    fit = stats.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(r["term"], round(r["estimate"], 3), round(r["std_error"], 3)) for r in fit], _FITTED)


@query("""WITH g AS (SELECT l_quantity - avg(l_quantity) OVER w AS x, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_linenumber FROM lineitem WINDOW w AS (PARTITION BY l_linenumber)),
 m AS (SELECT count(*) AS n, count(DISTINCT l_linenumber) AS k, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM g)
 SELECT 'l_quantity' AS term, round(xy / xx, 3) AS estimate, round(sqrt((yy - xy * xy / xx) / (n - 1 - k) / xx), 3) AS std_error FROM m""")
def fixed_effects_fit(spark, d):
    fit = stats.fixed_effects(table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(r["term"], round(r["estimate"], 3), round(r["std_error"], 3)) for r in fit], _FITTED)


@query(None)
def median_regression(spark, d):
    return stats.quantile_regression(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", ["c_nationkey"])
