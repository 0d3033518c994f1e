"""Market-data shapes over the driver's tables: adjusted prices, constituents, symbols, nested JSON, registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import table, tables
from ..functions import scalars
from ..operators import quality, registry, stats
from .registry import exact_sum, query


@query("""WITH f AS (SELECT user_id, event_id, ts, value, CASE WHEN event_id % 10 = 0 THEN 0.5 ELSE 1.0 END AS factor FROM events)
 SELECT user_id, event_id, value * coalesce(product(factor) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS adjusted FROM f""")
def adjusted_prices(spark, d):
    e = table(spark, d, "events").withColumn("factor", F.when(F.col("event_id") % 10 == 0, 0.5).otherwise(1.0))
    later = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    return e.select("user_id", "event_id", scalars.adjusted("value", "factor", later).alias("adjusted"))


@query("""WITH m AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderdate)::DATE END AS b FROM orders GROUP BY 1)
 SELECT o_custkey FROM m WHERE a <= DATE '1998-06-30' AND (b IS NULL OR b >= DATE '1998-06-30')""")
def index_members_asof(spark, d):
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("last"))
    on = F.lit("1998-06-30").cast("date")
    return m.filter((F.col("a") <= on) & ((F.col("o_custkey") % 2 != 0) | (F.col("last") >= on))).select("o_custkey")


@query("SELECT o.o_orderkey FROM orders o WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def chain_expansion(spark, d):
    o, c = tables(spark, d, "orders", "customer")
    return o.join(c.filter("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("SELECT s.s_suppkey AS symbol, n.n_name AS converted FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_nationkey < 20")
def symbol_conversion(spark, d):
    s, n = tables(spark, d, "supplier", "nation")
    known = n.filter("n_nationkey < 20")
    return s.join(known, s.s_nationkey == known.n_nationkey, "left").select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("converted"))


@query("SELECT n_regionkey, n_name AS holding, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INT) AS rank FROM nation")
def fund_holdings(spark, d):
    n = table(spark, d, "nation")
    held = F.transform(F.array_sort(F.collect_list("n_name")), lambda x, i: F.struct(x.alias("name"), (i + 1).alias("rank")))
    doc = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.array(F.struct(held.alias("holdings"))).alias("results"))).alias("json"))
    results = F.from_json("json", "results array<struct<holdings:array<struct<name:string,rank:int>>>>")["results"]
    return doc.select("n_regionkey", F.explode(results).alias("r")).select("n_regionkey", F.inline("r.holdings")).withColumnRenamed("name", "holding")


@query("SELECT user_id, max(CAST(ts AS DATE)) AS holdings_date FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15' GROUP BY 1", dates=("holdings_date",))
def holdings_asof(spark, d):
    days = table(spark, d, "events").filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return days.groupBy("user_id").agg(F.max(F.col("ts").cast("date")).alias("holdings_date"))


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name))[1:3], ',') AS first_three FROM nation GROUP BY 1")
def sorted_array_slice(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.slice(F.sort_array(F.collect_list("n_name")), 1, 3), ",").alias("first_three"))


@query("SELECT DISTINCT key AS field FROM (SELECT unnest(json_keys(props)) AS key FROM events)")
def field_catalogue(spark, d):
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("field")).distinct()


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'part')")
def lower_contains(spark, d):
    return table(spark, d, "part").filter(F.lower("p_name").contains("part")).select("p_partkey")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_columns(spark, d):
    p = table(spark, d, "part")
    return p.select(*stats.numeric(p))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_orderkey % 2 = 0)")
def flag_and_status(spark, d):
    o = table(spark, d, "orders").withColumn("flag", F.col("o_orderkey") % 2 == 0)
    labels = F.create_map(*map(F.lit, ("F", "finished", "O", "open")))
    return o.filter(F.col("flag")).select("o_orderkey", F.try_element_at(labels, "o_orderstatus").alias("status")).filter("status is not null")


@query("SELECT k.place, c.c_custkey, c.c_name FROM (VALUES (1, 5), (2, 3), (3, 9)) k(place, id) JOIN customer c ON c.c_custkey = k.id")
def ordered_lookup(spark, d):
    keys = spark.createDataFrame([(1, 5), (2, 3), (3, 9)], "place int, id long")
    return table(spark, d, "customer").join(F.broadcast(keys), F.col("c_custkey") == F.col("id")).select("place", "c_custkey", "c_name")


@query("SELECT year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders WHERE o_orderpriority ILIKE '%urgent%' GROUP BY 1")
def filtered_group_sum(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderpriority").ilike("%urgent%"))
    return o.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(exact_sum("o_totalprice").alias("total"))


@query("SELECT array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer WHERE c_mktsegment IS NOT NULL")
def unique_list(spark, d):
    return table(spark, d, "customer").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1", dates=("day",))
def records_per_day(spark, d):
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS metadata FROM nation""")
def nested_to_json(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("metadata"))


@query("SELECT event_id FROM events WHERE value >= 80")
def confidence_filter(spark, d):
    return quality.confident(table(spark, d, "events"), "value", 80).select("event_id")


@query("SELECT n_name AS name, '| ' || n_name || ' | region ' || n_regionkey || ' | ' || CASE n_nationkey % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'CHEAP' ELSE 'EXPENSIVE' END || ' |' AS row FROM nation")
def catalogue_table(spark, d):
    n = table(spark, d, "nation")
    cost = F.element_at(F.array(*map(F.lit, ("FREE", "CHEAP", "EXPENSIVE"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    skills = n.select(F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description"), cost.alias("cost"))
    return registry.catalogue_rows(skills).select("name", "row")


@query("SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey < 24")
def cell_edges(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey < 25")
    cells = n.select(F.lit("nb").alias("path"), F.col("n_nationkey").cast("long").alias("line"), F.when(F.col("n_nationkey") > 0, F.array(F.concat(F.lit("v"), (F.col("n_nationkey") - 1).cast("string")))).otherwise(F.array().cast("array<string>")).alias("inputs"), F.array(F.concat(F.lit("v"), F.col("n_nationkey").cast("string"))).alias("outputs"))
    return registry.edges(cells).select(F.col("source").cast("int").alias("a"), F.col("target").cast("int").alias("b"))


@query("SELECT CAST(n AS INT) AS n, CAST(n * n AS INT) AS square FROM generate_series(0, 9) t(n)")
def generated_rows(spark, d):
    @F.udtf(returnType="n int, square int")
    class Squares:
        def eval(self, most: int):
            for n in range(most):
                yield n, n * n

    return Squares(F.lit(10))


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1")
def parquet_glob(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet*").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def running_total(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,4)")).over(w).cast("double").alias("running"))


@query("SELECT n_regionkey, r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (n_regionkey, r_name)")
def rollup_counts(spark, d):
    n, r = tables(spark, d, "nation", "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).rollup("n_regionkey", "r_name").agg(F.count("*").alias("nations"))


@query("SELECT e.event_id, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = e.user_id) AS newest_order FROM events e")
def correlated_lookup(spark, d):
    e, o = tables(spark, d, "events", "orders")
    newest = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest_order"))
    return e.join(newest, e.user_id == newest.o_custkey, "left").select("event_id", "newest_order")
