"""Ratios, name lookups, reports, nested vendor documents, sessions and registries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table, tables
from ..functions import scalars
from ..functions import text as tx
from ..operators import nested, quality, registry
from ..operators import relational as rel
from .registry import exact_sum, query

_ACCOUNTS = """a AS (SELECT o_custkey, year(o_orderdate) AS fyear, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revt, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (o_orderstatus = 'F') AS DOUBLE), 0) AS ni,
 CAST(count(*) AS DOUBLE) AS assets, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS seq, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS lt, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS dltt,
 CAST(count(*) FILTER (o_orderpriority = '2-HIGH') AS DOUBLE) AS dlc, CAST(count(*) FILTER (o_orderpriority = '3-MEDIUM') AS DOUBLE) AS che, max(o_totalprice) AS mkvalt FROM orders GROUP BY 1, 2)"""


@query(f"""WITH {_ACCOUNTS} SELECT o_custkey, fyear, round(ni / nullif(revt, 0), 6) AS net_margin, round(ni / nullif(assets, 0), 6) AS roa, round(ni / nullif(seq, 0), 6) AS roe, round(lt / nullif(assets, 0), 6) AS debt_to_assets,
 round((dltt + dlc) / nullif(seq, 0), 6) AS debt_to_equity, round(che / nullif(assets, 0), 6) AS cash_ratio, round(mkvalt / nullif(ni, 0), 6) AS pe_ratio, round(mkvalt / nullif(seq, 0), 6) AS pb_ratio FROM a""")
def financial_ratios(spark, d):
    number = lambda condition: F.count_if(condition).cast("double")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    a = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("fyear")).agg(
        exact_sum("o_totalprice").alias("revt"), F.coalesce(exact_sum(F.when(status == "F", F.col("o_totalprice"))), F.lit(0.0)).alias("ni"), F.count("*").cast("double").alias("at"),
        number(status == "F").alias("seq"), number(status == "O").alias("lt"), number(priority == "1-URGENT").alias("dltt"), number(priority == "2-HIGH").alias("dlc"), number(priority == "3-MEDIUM").alias("che"), F.max("o_totalprice").alias("mkvalt"),
    )
    made = scalars.ratios(**{n: F.col(n) for n in ("ni", "revt", "at", "seq", "lt", "dltt", "dlc", "che", "mkvalt")})
    return a.select("o_custkey", "fyear", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query("""WITH n AS (SELECT DISTINCT unnest([lower(trim(p_name)), split_part(lower(trim(p_name)), ' ', 1)]) AS pattern FROM part WHERE p_size = 7)
 SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM n WHERE pattern <> '' AND contains(lower(p_name), pattern))""")
def name_lookup(spark, d):
    p = table(spark, d, "part")
    return rel.any_name(p.select("p_partkey", "p_name"), "p_name", p.filter("p_size = 7").select(F.col("p_name").alias("input")).distinct(), "input").select("p_partkey")


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price FROM orders")
def number_formats(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.thousands(F.col("o_totalprice")).alias("price"))


@query("SELECT event_id, format('{:+.1f}', (floor(value) - 100) / 10) AS over FROM events")
def signed_numbers(spark, d):
    return table(spark, d, "events").select("event_id", scalars.signed((F.floor("value") - 100) / 10).alias("over"))


@query("""(SELECT o_orderkey, o_custkey, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey, o_custkey, 'tail' FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def head_and_tail(spark, d):
    return rel.preview(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 5, "o_orderkey")


@query("""WITH s AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY total DESC, o_custkey) AS place FROM s)
 SELECT CAST(place AS INT) AS place, lpad(CAST(place AS VARCHAR), 4, ' ') || '. customer ' || o_custkey || ': ' || format('{:,}', CAST(floor(total) AS BIGINT)) || ' (' || n || ' orders)' AS line FROM r WHERE place <= 25""")
def ranked_lines(spark, d):
    s = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(exact_sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    first = rel.top_n(s, "total", 25, "o_custkey")
    place = F.row_number().over(rel.Window.orderBy(F.col("total").desc(), "o_custkey"))  # of 25 rows
    line = F.concat(F.lpad(F.col("place").cast("string"), 4, " "), F.lit(". customer "), F.col("o_custkey").cast("string"), F.lit(": "), F.format_number(F.floor("total"), 0), F.lit(" ("), F.col("n").cast("string"), F.lit(" orders)"))
    return first.withColumn("place", place).select("place", line.alias("line"))


# Nested vendor documents, made of the tables as JSON and read back


def _funds(spark, d):
    """A document for each region: its nations are holdings, fees and benchmarks."""
    n, r = tables(spark, d, "nation", "region")
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("percent")))).alias("items"))
    rows = rows.join(r, rows.n_regionkey == r.r_regionkey)
    entry = F.struct(F.col("items").alias("holdings"), F.transform("items", lambda x: F.struct(x["name"].alias("name"), F.concat(F.lit("."), x["name"]).alias("ric"))).alias("benchmarks"), F.col("r_name").alias("manager"), F.size("items").alias("shareTna"))
    return rows.select(F.col("n_regionkey").alias("fund"), F.to_json(F.struct(F.lit(False).alias("isError"), F.array(entry).alias("results"))).alias("json"))


@query("""SELECT n_regionkey AS fund, 'TTH' AS module, n_name AS name, CAST(n_nationkey AS DOUBLE) AS number, NULL AS ric FROM nation UNION ALL SELECT n_regionkey, 'BEN', n_name, NULL, '.' || n_name FROM nation
 UNION ALL SELECT r_regionkey, 'KEY', r_name, count(n_name), NULL FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 3""")
def fund_modules(spark, d):
    docs = _funds(spark, d)
    held = nested.fund_module(docs, "TTH", "name:string,percent:double").select("fund", F.lit("TTH").alias("module"), "name", F.col("percent").alias("number"))
    bench = nested.fund_module(docs, "BEN", "name:string,ric:string").select("fund", F.lit("BEN").alias("module"), "name", "ric")
    keys = nested.fund_module(docs, "KEY", "manager:string,shareTna:double").select("fund", F.lit("KEY").alias("module"), F.col("manager").alias("name"), F.col("shareTna").alias("number"))
    return held.unionByName(bench, allowMissingColumns=True).unionByName(keys, allowMissingColumns=True).select("fund", "module", "name", "number", "ric")


def _dated(spark, d):
    """A document for each user: a dated result for each month, its event types are groups and events items."""
    e = table(spark, d, "events").withColumn("month", F.date_format("ts", "yyyy-MM-01"))
    groups = e.groupBy("user_id", "month", "event_type").agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("ric"), F.lit("x").alias("name"), F.col("value").alias("percent"))).alias("items"))
    results = groups.groupBy("user_id", "month").agg(F.collect_list(F.struct(F.col("event_type").alias("id"), F.col("event_type").alias("name"), "items")).alias("groups"))
    made = results.groupBy("user_id").agg(F.collect_list(F.struct(F.array(F.concat("month", F.lit("T00:00:00"))).alias("availableDates"), F.concat("month", F.lit("T00:00:00")).alias("date"), "groups")).alias("results"))
    return made.select(F.col("user_id").alias("fund"), F.to_json(F.struct("results")).alias("json"))


@query("SELECT user_id AS fund, date_trunc('month', ts)::DATE AS date, event_type AS \"group\", CAST(event_id AS VARCHAR) AS ric, value AS percent FROM events", dates=("date",))
def dated_holdings(spark, d):
    return nested.holdings(_dated(spark, d)).select("fund", "date", "group", "ric", "percent")


@query("SELECT DISTINCT user_id AS fund, date_trunc('month', ts)::DATE AS date FROM events", dates=("date",))
def available_dates(spark, d):
    return nested.available_dates(_dated(spark, d))


@query("WITH m AS (SELECT user_id, max(date_trunc('month', ts)::DATE) AS m FROM events WHERE date_trunc('month', ts)::DATE <= DATE '2024-01-20' GROUP BY 1) SELECT e.user_id AS fund, CAST(e.event_id AS VARCHAR) AS ric FROM events e JOIN m ON e.user_id = m.user_id AND date_trunc('month', e.ts)::DATE = m.m")
def holdings_of_a_day(spark, d):
    return nested.as_of(nested.holdings(_dated(spark, d)), F.lit("2024-01-20").cast("date")).select("fund", "ric")


@query("SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, c_name AS company, 'A-' || o_orderkey AS accession, o_orderdate::DATE AS filed, o_orderpriority AS form, 'd' || o_orderkey || '.htm' AS document FROM orders JOIN customer ON o_custkey = c_custkey", dates=("filed",))
def submissions(spark, d):
    o, c = tables(spark, d, "orders", "customer")
    key = F.col("o_orderkey").cast("string")
    one = F.struct(F.concat(F.lit("A-"), key).alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("f"), F.col("o_orderpriority").alias("p"), F.concat(F.lit("d"), key, F.lit(".htm")).alias("d"))
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy("o_custkey", "c_name").agg(F.collect_list(one).alias("x"))
    pick = lambda n: F.transform("x", lambda v: v[n])
    recent = F.struct(pick("a").alias("accessionNumber"), pick("f").alias("filingDate"), pick("p").alias("form"), pick("d").alias("primaryDocument"))
    docs = rows.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.col("c_name").alias("name"), F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return nested.submissions(docs)


@query("SELECT p.page_id AS story_id, d.text IS NOT NULL AS found, length(d.text) AS n FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 2")
def story_texts(spark, d):
    p, docs = tables(spark, d, "pages", "documents")
    texts = docs.filter("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("bigint").alias("story_id"), "text")
    return nested.stories(p.select(F.col("page_id").alias("story_id")), texts).select("story_id", F.col("story").isNotNull().alias("found"), F.length("story").cast("long").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100")
def newest_headlines(spark, d):
    e = table(spark, d, "events").withColumnRenamed("ts", "at")
    return nested.newest_headlines(e, F.col("event_type") == "error", "2024-01-02", "2024-01-20", 500, "at", "event_id").select("event_id", "user_id")


@query("""WITH f AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND event_type IN ('click', 'error') GROUP BY 1, 2)
 SELECT u.user_id AS instrument, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'error') AS error FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f ON u.user_id = f.user_id GROUP BY 1""")
def point_in_time(spark, d):
    e = table(spark, d, "events")
    facts = e.select(F.col("user_id").alias("instrument"), F.col("event_type").alias("field"), "value", F.col("ts").alias("day"), F.struct("ts", "event_id").alias("at"))
    early = facts.filter(F.col("day") <= F.lit("2024-01-10").cast("timestamp_ntz"))
    return nested.point_in_time(early, e.select(F.col("user_id").alias("instrument")), ["click", "error"])


@query("""WITH t AS (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events), s AS (SELECT * FROM t WHERE m >= 240 AND m < 570 OR m >= 570 AND m < 960),
 b AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS trades FROM s GROUP BY 1, 2)
 SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start DESC) <= 3""")
def session_bars(spark, d):
    return nested.summaries(table(spark, d, "events"), "1 hour", 3, "user_id", "ts", "value", "event_id", ("PRE", "NORMAL"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment IN ('BUILDING', 'FURNITURE'))")
def screened_universe(spark, d):
    from ..operators import dsl

    o, c = tables(spark, d, "orders", "customer")
    picked = dsl.Screen('U(IN(Equity(active,public))), TR.Cash>=5000, IN(TR.Kind,"BUILDING","FURNITURE")').condition({"TR.Cash": "c_acctbal", "TR.Kind": "c_mktsegment"})
    return nested.screened(o, c.filter(picked).select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@query("SELECT n_name AS name, 'double' AS type, 'of ' || n_regionkey AS description FROM nation WHERE n_regionkey <> 3")
def field_catalogue_documents(spark, d):
    n = table(spark, d, "nation")
    fields = F.collect_list(F.struct(F.col("n_name").alias("name"), F.lit("double").alias("type"), F.concat(F.lit("of "), F.col("n_regionkey").cast("string")).alias("description")))
    docs = n.groupBy("n_regionkey").agg(F.to_json(F.struct(fields.alias("universe"), F.when(F.col("n_regionkey") == 3, F.repeat(F.lit("x"), 50_000)).alias("pad"))).alias("json"))
    return nested.field_catalogue(docs, most_chars=40_000)


# Registries


def _skills(spark, d):
    n = table(spark, d, "nation")
    cost = F.element_at(F.array(*map(F.lit, registry.COSTS)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    trigger = lambda word: F.struct(F.concat(F.lit("domain "), F.col("n_regionkey").cast("string")).alias("domain"), F.concat(F.lit(word), F.col("n_name")).alias("trigger"))
    some = F.when(F.col("n_nationkey") % 4 != 0, F.array(trigger("do "), trigger("see "))).otherwise(F.array().cast("array<struct<domain:string,trigger:string>>"))
    use = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("when even"), F.lit("or so")))
    return n.select(F.col("n_name").alias("name"), F.concat(F.lit("cat "), F.col("n_regionkey").cast("string")).alias("category"), cost.alias("cost"), F.when(F.col("n_nationkey") > 9, "NATION_1").alias("parent_skill"), some.alias("triggers"), use.alias("use_when"), F.lit(None).cast("array<string>").alias("avoid_when"))


@query("""SELECT 'name' AS by, n_name AS name FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT 'category', n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'cost', n_name FROM nation WHERE n_nationkey % 3 = 1
 UNION ALL SELECT 'parent', n_name FROM nation WHERE n_nationkey > 9 UNION ALL SELECT 'all', n_name FROM nation""")
def registry_lookups(spark, d):
    s = _skills(spark, d)
    found = {"name": {"name": "NATION_3"}, "category": {"category": "cat 2"}, "cost": {"cost": "CHEAP"}, "parent": {"parent": "NATION_1"}, "all": {}}
    frames = [registry.lookup(s, **how).select(F.lit(by).alias("by"), "name") for by, how in found.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("""WITH s AS (SELECT *, CASE n_nationkey % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'CHEAP' ELSE 'EXPENSIVE' END AS cost FROM nation)
 SELECT 'trigger' AS kind, n_name AS name, '| domain ' || n_regionkey || ' | `/' || n_name || '` | do ' || n_name || ', see ' || n_name || ' |' AS row FROM s WHERE n_nationkey % 4 <> 0
 UNION ALL SELECT 'cost', n_name, '| `/' || n_name || '` | ' || cost || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'when even' ELSE 'General use' END || ' |' FROM s
 UNION ALL SELECT 'delegation', n_name, '| domain ' || n_regionkey || ' | `/' || n_name || '` | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'when even' ELSE 'N/A' END || ' | N/A |' FROM s WHERE n_nationkey % 4 <> 0""")
def registry_tables(spark, d):
    s = _skills(spark, d)
    made = {"trigger": registry.trigger_rows(s), "cost": registry.cost_rows(s), "delegation": registry.delegation_rows(s)}
    out = None
    for kind, rows in made.items():
        rows = rows.select(F.lit(kind).alias("kind"), "name", "row")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'stata' WHEN 2 THEN 'markdown' END AS handler FROM pages""")
def file_handlers(spark, d):
    p = table(spark, d, "pages")
    name = F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, ("/a.R", "/b.ado", "/c.Markdown", "/d.txt"))), (F.col("page_id") % 4 + 1).cast("int")))
    return p.select("page_id", scalars.handler(name).alias("handler"))


@query("SELECT 'K' || user_id AS key, CAST(arg_min(value, event_id) AS VARCHAR) AS value FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def env_first_wins(spark, d):
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("# comment = no")).otherwise(F.concat(F.lit("K"), F.col("user_id").cast("string"), F.lit(' = "'), F.col("value").cast("string"), F.lit('"')))
    return tx.env_values(e.select("event_id", line.alias("value")), "event_id")


@query("""SELECT o_orderkey, o_orderdate::DATE - 1 AS day_before, o_orderdate::DATE - CASE isodow(o_orderdate) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS last_weekday, o_orderdate::DATE - 730 AS two_years FROM orders""", dates=("day_before", "last_weekday", "two_years"))
def relative_days(spark, d):
    o = table(spark, d, "orders")
    day = o.o_orderdate.cast("date")
    return o.select("o_orderkey", scalars.relative_day(day, 1).alias("day_before"), scalars.relative_day(day, 1, "weekday").alias("last_weekday"), scalars.relative_day(day, 2, "year").alias("two_years"))


@query("SELECT count(*) AS rows, count(*) FILTER (source IS NULL) AS source_nulls, count(*) FILTER (text IS NULL) AS text_nulls, min(doc_id) AS first, max(doc_id) AS last FROM documents")
def post_query_checks(spark, d):
    return quality.post_query(table(spark, d, "documents"), ["source", "text"], "doc_id")


@query("SELECT s_suppkey AS s_key, s_name AS supplier_name FROM supplier")
def snake_case_columns(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("S Key"), F.col("s_name").alias("SupplierName"))
    return rel.snake_case(s)


@query("SELECT c_custkey, s.s_suppkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey")
def identifier_map(spark, d):
    """Ids of one entity under three providers, through one mapping table."""
    c, n, s = tables(spark, d, "customer", "nation", "supplier")
    first = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"))
    mapping = n.join(first, "n_nationkey", "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "s_suppkey")
    return c.join(mapping, "c_nationkey").select("c_custkey", "s_suppkey", "n_name")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^(cold|small) .*t$')")
def regex_search(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").rlike("(?i)^(cold|small) .*t$")).select("p_partkey")


@query("SELECT n_nationkey, n_nationkey % 3 = 1 AS behind FROM nation")
def behind_remote(spark, d):
    n = table(spark, d, "nation")
    mark = F.when(F.col("n_nationkey") % 3 == 1, " [behind 2]").when(F.col("n_nationkey") % 3 == 2, " [ahead 1]").otherwise("")
    status = F.concat(F.lit("## main...origin/main"), mark, F.lit("\n M behind.txt\n?? [behind x"))
    return n.select("n_nationkey", registry.behind(status).alias("behind"))


@query("SELECT c_name AS name, CASE WHEN length(c_mktsegment) > 12 THEN substr(c_mktsegment, 1, 4) || '...' || substr(c_mktsegment, -4) ELSE '***' END AS shown FROM customer WHERE c_custkey IN (1, 2, 3) AND c_mktsegment <> 'BUILDING'")
def settings_present(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("value"))
    return registry.settings(c, [f"Customer#{n:09}" for n in (1, 2, 3)])


@query("SELECT count(*) FILTER (quality = 1) AS succeeded, count(*) FILTER (quality IS DISTINCT FROM 1) AS failed, count(*) AS total FROM labels")
def sync_tally(spark, d):
    return registry.tallied(table(spark, d, "labels"), F.col("quality") == 1)


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def passed_function(spark, d):
    """A function that one step defines and another applies."""
    finished = lambda df: df.filter("o_orderstatus = 'F'")
    totals = lambda df, by: df.groupBy(by).agg(exact_sum("o_totalprice").alias("total"))
    return table(spark, d, "orders").transform(finished).transform(totals, "o_custkey")
