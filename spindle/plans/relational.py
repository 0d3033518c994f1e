"""Projection, predicates, joins, sorts, sets and reshaping over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import sql, table, tables
from ..functions import scalars
from ..operators import dsl, stats
from ..operators import relational as rel
from .registry import exact_mean, exact_sum, query

_LINK = "min(o_orderdate)::DATE AS linkdt, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE max(o_orderdate)::DATE END AS linkenddt"


def _links(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("linkdt"), F.max("o_orderdate").cast("date").alias("last"))
    return o.select("o_custkey", "linkdt", F.when(F.col("o_custkey") % 3 != 0, F.col("last")).alias("linkenddt"))


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice * 2 AS doubled, abs(o_totalprice - 1000) AS gap, 'orders' AS origin FROM orders")
def project_alias(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), (F.col("o_totalprice") * 2).alias("doubled"), F.abs(F.col("o_totalprice") - 1000).alias("gap"), F.lit("orders").alias("origin"))


@query("SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS log_price, month(l_shipdate) AS ship_month, year(l_shipdate) AS ship_year FROM lineitem")
def add_columns(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    out = l.withColumns({"log_price": F.round(F.log("l_extendedprice"), 6), "ship_month": F.month("l_shipdate").cast("long"), "ship_year": F.year("l_shipdate").cast("long")})
    return out.drop("l_extendedprice", "l_shipdate")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(spark, d):
    return table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedupe_keep_last(spark, d):
    o = table(spark, d, "orders")
    return rel.dedupe_keep(o, "o_custkey", ["o_orderdate", "o_orderkey"], "last").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 30 AND l_discount > 0.05) OR NOT (l_returnflag = 'N') AND l_tax <> 0")
def boolean_predicates(spark, d):
    l = table(spark, d, "lineitem")
    return l.filter((F.col("l_quantity") >= 30) & (F.col("l_discount") > 0.05) | ~(F.col("l_returnflag") == "N") & (F.col("l_tax") != 0)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = ANY([1, 3, 5, 7])")
def any_array(spark, d):
    return sql(spark, "SELECT c_custkey FROM {c} WHERE array_contains(:ids, c_nationkey)", {"ids": F.array(*map(F.lit, (1, 3, 5, 7)))}, c=table(spark, d, "customer"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def between_dates(spark, d):
    o = table(spark, d, "orders")
    return o.filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' OR p_name LIKE 'a%'")
def like_chain(spark, d):
    return table(spark, d, "part").filter(F.col("p_type").like("%BRASS%") | F.col("p_name").like("a%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%GREEN%' OR upper(p_type) LIKE '%STEEL%'")
def ilike_upper(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").ilike("%GREEN%") | F.upper("p_type").like("%STEEL%")).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%customer#000000001%' OR c_name ILIKE '%customer#000000022%'")
def ilike_any(spark, d):
    patterns = F.array(F.lit("%customer#000000001%"), F.lit("%customer#000000022%"))
    return sql(spark, "SELECT c_custkey, c_name FROM {c} WHERE exists(:p, x -> c_name ILIKE x)", {"p": patterns}, c=table(spark, d, "customer"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders WHERE nullif(o_orderstatus, 'O') IS NOT NULL")
def not_null(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status")).filter(F.col("status").isNotNull())


@query("SELECT event_id, user_id, CAST(nullif(event_type, 'click') AS VARCHAR) AS kind FROM events WHERE nullif(event_type, 'click') IS NOT NULL AND user_id IS NOT NULL")
def drop_null_keys(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("click")).alias("kind"))
    return e.na.drop(subset=["kind", "user_id"])


@query("SELECT event_id, coalesce(nullif(event_type, 'view'), 'missing') AS kind, CASE WHEN value > 50 THEN 0.0 ELSE value END AS value FROM events")
def fill_defaults(spark, d):
    e = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(~(F.col("value") > 50), F.col("value")).alias("value"))
    return e.na.fill({"kind": "missing", "value": 0.0})


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) SELECT event_id, v IS NULL AS imputed, coalesce(v, (SELECT median(v) FROM e)) AS value FROM e")
def median_imputation(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return e.join(F.broadcast(stats.median(e, "v").withColumnRenamed("v", "m"))).select("event_id", F.col("v").isNull().alias("imputed"), F.coalesce("v", "m").alias("value"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '(?i)(^|[^A-Za-z0-9_])(promo|economy)([^A-Za-z0-9_]|$)')")
def regex_words(spark, d):
    return table(spark, d, "part").filter(F.col("p_type").rlike("(?i)(^|[^A-Za-z0-9_])(promo|economy)([^A-Za-z0-9_]|$)")).select("p_partkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'Executive Officer' WHEN o_orderpriority = '2-HIGH' THEN 'Senior Officer'
 WHEN o_orderstatus = 'F' THEN 'Director' WHEN o_orderstatus = 'O' THEN 'Officer' ELSE 'Other Insider' END AS role FROM orders""")
def case_ladder(spark, d):
    role = F.when(F.col("o_orderpriority").isin("1-URGENT"), "Executive Officer").when(F.col("o_orderpriority") == "2-HIGH", "Senior Officer").when(F.col("o_orderstatus") == "F", "Director").when(F.col("o_orderstatus") == "O", "Officer").otherwise("Other Insider")
    return table(spark, d, "orders").select("o_orderkey", role.alias("role"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal / 1e3 >= 2 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <= 20")
def screen_dsl(spark, d):
    s = dsl.Screen('U(IN(Equity(active,public))), /*large*/ TR.Balance(Scale=3)>=2, IN(TR.Segment,"BUILDING","MACHINERY"), TR.Nation<=20, CURN=USD')
    return table(spark, d, "customer").filter(s.condition({"TR.Balance": "c_acctbal", "TR.Segment": "c_mktsegment", "TR.Nation": "c_nationkey"})).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE (source = 'src1' OR source = 'src2') AND lang = 'en' AND NOT contains(lower(text), 'license')")
def news_dsl(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(dsl.news_query("(R:src1 OR R:src2) AND Language:en AND NOT license", {"R": docs.source, "Language": docs.lang}, docs.text)).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0")
def positional_parameters(spark, d):
    return sql(spark, "SELECT o_orderkey FROM {o} WHERE o_orderstatus = ? AND o_totalprice > ?", ["F", 100000.0], o=table(spark, d, "orders"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 50000.0")
def named_parameters(spark, d):
    return sql(spark, "SELECT o_orderkey FROM {o} WHERE o_orderstatus = :s AND o_totalprice < :p", {"s": "O", "p": 50000.0}, o=table(spark, d, "orders"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def optional_predicates(spark, d):
    status, least, most = "F", 1000, None
    given = [F.col("o_orderstatus") == status if status else None, F.col("o_totalprice") >= least if least is not None else None, F.col("o_totalprice") <= most if most is not None else None]
    return table(spark, d, "orders").filter(rel.all_of(given)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'")
def policy_filters(spark, d):
    policy = rel.FilterPolicy(l_linestatus="F", l_returnflag="R")
    policy.check({"l_linestatus": "F", "l_returnflag": "R"})
    out = policy.apply(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber")
    policy.check_plan(out)
    return out


@query("SELECT s_suppkey AS supplier, s_name AS supplier_name, s_nationkey AS nation FROM supplier")
def rename_columns(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").toDF("supplier", "supplier_name", "nation")


# The oracle rounds half to even in whole hundredths, of which 10,000 are one ten-thousandth of a million.
@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS INT) AS quantity FROM lineitem)
 SELECT l_orderkey, l_linenumber, (cents // 10000 + CASE WHEN cents % 10000 > 5000 OR cents % 10000 = 5000 AND (cents // 10000) % 2 = 1 THEN 1 ELSE 0 END) / 10000.0::DOUBLE AS millions, quantity FROM c""")
def rescale_cast(spark, d):
    millions = F.bround(F.col("l_extendedprice").cast("decimal(18,2)") / F.lit(1_000_000).cast("decimal(7,0)"), 4).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", millions.alias("millions"), F.col("l_quantity").cast("int").alias("quantity"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE strftime(o_orderdate, '%d.%m.%Y') END AS said FROM orders)
 SELECT o_orderkey, CAST(try_strptime(said, '%d.%m.%Y') AS DATE) AS day FROM t""", dates=("day",))
def parse_dates(spark, d):
    o = table(spark, d, "orders")
    said = F.when(o.o_orderstatus == "P", o.o_orderpriority).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return o.select("o_orderkey", F.try_to_timestamp(said, F.lit("dd.MM.yyyy")).cast("date").alias("day"))


@query("""WITH p AS (SELECT o_custkey, year(o_orderdate) AS fyear, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revt, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS seq, CAST(count(*) AS DOUBLE) AS ta
 FROM orders GROUP BY 1, 2) SELECT o_custkey, fyear, round(revt / nullif(seq, 0), 6) AS roe, round(seq / nullif(ta, 0), 6) AS equity_ratio FROM p""")
def ratios_nullif(spark, d):
    p = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("fyear")).agg(exact_sum("o_totalprice").alias("revt"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("seq"), F.count("*").cast("double").alias("ta"))
    return p.select("o_custkey", "fyear", F.round(F.try_divide("revt", "seq"), 6).alias("roe"), F.round(F.try_divide("seq", "ta"), 6).alias("equity_ratio"))


# Joins


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def inner_join(spark, d):
    o, c, n = tables(spark, d, "orders", "customer", "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 0) AS total, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_totals(spark, d):
    c, o = tables(spark, d, "customer", "orders")
    totals = o.groupBy("o_custkey").agg(exact_sum("o_totalprice").alias("t"), F.count("*").alias("n"))
    return c.join(totals, c.c_custkey == totals.o_custkey, "left").select("c_custkey", F.coalesce("t", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("orders"))


@query("""SELECT l.l_orderkey, l.l_linenumber, h.l_shipdate AS header_date FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'R') h
 ON l.l_orderkey = h.l_orderkey AND l.l_linenumber = h.l_linenumber""")
def left_join_composite(spark, d):
    l = table(spark, d, "lineitem")
    h = l.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("header_date"))
    return l.select("l_orderkey", "l_linenumber").join(h, ["l_orderkey", "l_linenumber"], "left")


@query(f"""WITH link AS (SELECT o_custkey, {_LINK} FROM orders GROUP BY o_custkey)
 SELECT o.o_orderkey, link.linkdt FROM orders o JOIN link ON o.o_custkey = link.o_custkey AND o.o_orderdate::DATE >= linkdt AND (o.o_orderdate::DATE <= linkenddt OR linkenddt IS NULL)""", dates=('linkdt',))
def ccm_interval_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("on"))
    return rel.interval_join(o, _links(spark, d), ["o_custkey"], "on", "linkdt", "linkenddt").select("o_orderkey", "linkdt")


@query("""WITH h AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
 SELECT h.day, e.event_id FROM h JOIN (SELECT event_id, CAST(ts AS DATE) AS a FROM events) e ON e.a BETWEEN h.day AND h.day + 3""", dates=('day',))
def event_windows(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("a"))
    h = e.select(F.col("a").alias("day")).distinct().withColumn("until", F.date_add("day", 3))
    return rel.range_join(e, h, "a", "day", "until").select("day", "event_id")


@query("""WITH a AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT date_trunc('month', l_shipdate)::DATE AS m, count(*) AS lines FROM lineitem GROUP BY 1)
 SELECT a.m, orders, lines FROM a JOIN b ON a.m = b.m""", dates=('m',))
def month_key_join(spark, d):
    o, l = tables(spark, d, "orders", "lineitem")
    a = o.groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").alias("orders"))
    return a.join(l.groupBy(F.trunc("l_shipdate", "month").alias("m")).agg(F.count("*").alias("lines")), "m")


@query("SELECT o_custkey, max(o_orderdate) AS at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_link(spark, d):
    o = table(spark, d, "orders").withColumn("at", F.col("o_orderdate"))
    return rel.latest_per_key(o, "o_custkey", "at", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, d):
    c, o = tables(spark, d, "customer", "orders")
    return c.join(o.filter("o_totalprice > 200000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_antijoin(spark, d):
    docs, labels = tables(spark, d, "documents", "labels")
    return docs.join(labels, "doc_id", "left_anti").select("doc_id")


@query(None)
def fuzzy_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    names = p.select(F.col("p_name").alias("name")).distinct()
    return rel.fuzzy_match(names, p, "name", "p_name", 0.7)


@query("""WITH a AS (SELECT substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 1, 8) AS cusip8, p_partkey FROM part), b AS (SELECT substr(lpad(CAST(s_suppkey * 10 AS VARCHAR), 9, '0'), 1, 8) AS cusip8, s_suppkey FROM supplier)
 SELECT cusip8, p_partkey, s_suppkey FROM a JOIN b USING (cusip8)""")
def cusip_bridge(spark, d):
    p, s = tables(spark, d, "part", "supplier")
    a = p.select(scalars.cusip8(F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("cusip8"), "p_partkey")
    return a.join(s.select(scalars.cusip8(F.lpad((F.col("s_suppkey") * 10).cast("string"), 9, "0")).alias("cusip8"), "s_suppkey"), "cusip8")


@query("""WITH h AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM h GROUP BY 1)
 SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM h a JOIN h b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def portfolio_overlap(spark, d):
    return rel.pair_counts(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


# Sorts, limits, sets, reshaping


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def largest_orders(spark, d):
    return rel.top_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def third_page(spark, d):
    return rel.page(table(spark, d, "customer").select("c_custkey"), 2, 20, "c_custkey")


@query("SELECT event_id FROM events ORDER BY md5('42:' || event_id) LIMIT 50")
def random_sample(spark, d):
    return rel.sample_exact(table(spark, d, "events").select("event_id"), 50, 42, "event_id")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 0 END AS place FROM orders")
def enumerated_rank(spark, d):
    order = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    return table(spark, d, "orders").select("o_orderkey", F.array_position(order, F.col("o_orderpriority")).alias("place"))


@query("""SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def tagged_union(spark, d):
    c, s = tables(spark, d, "customer", "supplier")
    return rel.union_tagged({"customer": c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), "supplier": s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))})


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'late' ELSE 'early' END AS state FROM customer")
def last_wins_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return rel.last_wins([c.withColumn("state", F.lit("early")), c.filter("id % 2 = 0").withColumn("state", F.lit("late"))], "id")


@query("SELECT o_orderkey, 'o_totalprice' AS field, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders")
def unpivot_fields(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double"))
    return o.unpivot("o_orderkey", ["o_totalprice", "o_custkey"], "field", "value")


@query("""SELECT year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS "F", CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS "O" FROM orders GROUP BY 1""")
def wide_panel(spark, d):
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus").agg(exact_sum("o_totalprice").alias("t"))
    return rel.wide(o, "y", "o_orderstatus", "t", ["F", "O"])


@query("WITH r AS (SELECT *, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part), t AS (SELECT * FROM r WHERE rank <= 3) SELECT p_partkey, rank FROM t")
def cte_chain(spark, d):
    return sql(spark, "WITH r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM {p}), t AS (SELECT * FROM r WHERE rank <= 3) SELECT p_partkey, rank FROM t", p=table(spark, d, "part"))


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS BIGINT) AS chunk FROM documents")
def chunk_requests(spark, d):
    return rel.chunked(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS DATE) AS day", dates=('day',))
def date_spine(spark, d):
    return spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-03-31')) AS day")
