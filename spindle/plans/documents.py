"""Text rules, scalar functions, JSON, batch bookkeeping and registries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import sql, table, tables
from ..functions import scalars
from ..functions import text as tx
from ..operators import batch, quality, registry, rules
from ..operators import relational as rel
from ..sources import files
from .registry import query

# Rules whose patterns are cheap to count; the others are in text_rules_all.
_COUNTED = ("search_token", "citation_placeholder", "refusal", "puffery", "promotional", "false_range", "bold")


def _counts(names=None) -> str:
    """SQL that counts the same patterns."""
    wanted = [(r, s, p) for r, s, p in rules.RULES if names is None or r in names]
    parts = [f"SELECT doc_id, '{r}' AS rule, '{s}' AS severity, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS hits FROM documents" for r, s, p in wanted]
    return "WITH h AS (" + " UNION ALL ".join(parts) + ") SELECT * FROM h WHERE hits > 0"


@query(_counts(_COUNTED))
def text_rules(spark, d):
    return rules.score(table(spark, d, "documents"), rules=tuple(r for r in rules.RULES if r[0] in _COUNTED))


@query(_counts())
def text_rules_all(spark, d):
    return rules.score(table(spark, d, "documents"))


_ADVISED = {**{p: f"write: {r}" for p, r in rules.SUGGESTIONS.items()}, **rules.ADVICE}


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phrase, '{a}' AS advice, CAST(len(regexp_extract_all(text, '(?i){p}')) AS BIGINT) AS hits FROM documents" for p, a in _ADVISED.items()) + ") SELECT * FROM h WHERE hits > 0")
def phrase_advice(spark, d):
    return rules.advice(table(spark, d, "documents"))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for r, _, p in rules.RULES if r in rules.DECISIVE))
def decisive_rules(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(rules.decisive(docs.text)).select("doc_id")


@query("SELECT doc_id, round(CAST(len(regexp_extract_all(text, 'the')) AS DOUBLE) / nullif(len(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda w: w <> '')), 0), 9) AS density FROM documents")
def term_density(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.round(rules.density(docs.text, "the"), 9).alias("density"))


def _replaced() -> str:
    out = "text"
    for phrase, plain in rules.SUGGESTIONS.items():
        out = f"regexp_replace({out}, '(?i){phrase}', '{plain}', 'g')"
    return out


@query(f"SELECT doc_id, {_replaced()} AS text FROM documents")
def suggestions(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", rules.suggest(docs.text).alias("text"))


@query("SELECT doc_id, NOT regexp_matches(rtrim(text, ' ' || chr(10) || chr(13) || chr(9)), '[.!?…:;)\"''”’\\]]$') AS cut_off FROM documents")
def cut_off(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", rules.cut_off(docs.text).alias("cut_off"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages")
def utm_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("QUERY"), F.lit("utm_source")).alias("utm_source"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title FROM pages")
def regex_first_group(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"))


@query("WITH t AS (SELECT doc_id, 'Item 1. Business ' || text || ' Item 1A. Risk' AS x FROM documents) SELECT doc_id, trim(regexp_extract(x, '(?is)Item\\s+1\\.?\\s+Business(.*?)Item\\s+1A', 1), ' ' || chr(9) || chr(10) || chr(13)) AS section FROM t")
def section_extract(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Item 1. Business "), F.col("text"), F.lit(" Item 1A. Risk")).alias("x"))
    return docs.select("doc_id", tx.section(F.col("x"), "Item 1").alias("section"))


@query(None)
def smartquote_diff(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.inline(tx.changed_lines(docs.text, tx.smart_quotes(docs.text))))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS') THEN 'brass' WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'hard' ELSE 'other' END AS kind FROM part")
def ordered_classifier(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", tx.classify(p.p_type, {"brass": "BRASS", "hard": "STEEL|TIN"}, "other").alias("kind"))


@query("SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 4) || '...' || substr(c_name, -4) ELSE '***' END AS masked FROM customer")
def secret_mask(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", tx.mask_secret(c.c_name).alias("masked"))


@query("""WITH u AS (SELECT *, 'https://host/Archives/edgar/data/' || o_custkey || '/' || replace('0000-' || o_orderkey, '-', '') AS folder FROM orders)
 SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_custkey AS VARCHAR) AS bare, ltrim(lpad(CAST(o_custkey AS VARCHAR), 10, '0'), '0') AS stripped,
 folder, folder || '/xslF345X03/primarydocument.xml' AS viewer, folder || '/0000-' || o_orderkey || '-index.htm' AS index, folder || '/0000-' || o_orderkey || '.txt' AS full_text, folder || '/a.htm' AS document FROM u""")
def identifiers(spark, d):
    o = table(spark, d, "orders")
    cik = scalars.pad_cik(o.o_custkey.cast("string"))
    urls = scalars.filing_urls(cik, F.concat(F.lit("0000-"), o.o_orderkey.cast("string")), "https://host", F.lit("a.htm"))
    return o.select("o_orderkey", cik.alias("cik"), scalars.plain_cik(cik).alias("bare"), scalars.unpad(cik).alias("stripped"), *[c.alias(n) for n, c in urls.items()])


@query("SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base, lower(regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '.(\\.[^.]*)$', 1)) AS suffix FROM pages")
def path_parts(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", scalars.basename(p.url).alias("base"), scalars.suffix(p.url).alias("suffix"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'application/pdf' WHEN 'de' THEN 'application/octet-stream' WHEN 'fr' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS batch,
 CASE lang WHEN 'en' THEN 'application/pdf' WHEN 'de' THEN 'image/heic' WHEN 'fr' THEN 'image/jpeg' ELSE 'video/3gpp' END AS media, CASE lang WHEN 'fr' THEN 'image/jpeg' ELSE 'image/png' END AS icon FROM documents""")
def mime_types(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("a.b"), F.when(docs.lang == "en", ".PDF").when(docs.lang == "de", ".heic").when(docs.lang == "fr", ".jpeg").otherwise(".3gp"))
    return docs.select("doc_id", *[scalars.mime_type(name, use).alias(use) for use in ("batch", "media", "icon")])


@query("SELECT doc_id, 'doc' || doc_id || '_' || substr(md5(text), 1, 8) || '_' || substr(md5('Summarise.'), 1, 6) AS request_id FROM documents")
def batch_request_ids(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("gs://bucket/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", scalars.request_id(path, docs.text, F.lit("Summarise.")).alias("request_id"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, CAST(o_orderdate AS DATE) + 1 AS next_day, CAST(o_orderdate AS DATE) - 30 AS month_before, DATE '1960-01-01' + CAST(o_orderkey % 20000 AS INT) AS sas FROM orders", dates=('next_day', 'month_before', 'sas',))
def date_functions(spark, d):
    o = table(spark, d, "orders")
    day = o.o_orderdate.cast("date")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("compact"), F.date_add(day, 1).alias("next_day"), F.date_sub(day, 30).alias("month_before"), scalars.sas_date(o.o_orderkey % 20000).alias("sas"))


@query("SELECT event_id, substr('FYFQFS', 1 + 2 * (event_id % 3)::INT, 2) AS unit, -(event_id % 5)::INT AS offset FROM events")
def fiscal_periods(spark, d):
    e = table(spark, d, "events")
    code = F.concat(F.element_at(F.array(*map(F.lit, ("FY", "FQ", "FS"))), (e.event_id % 3 + 1).cast("int")), (-(e.event_id % 5)).cast("string"))
    return e.select("event_id", F.inline(F.array(scalars.fiscal_period(code))))


@query("SELECT event_id, CASE WHEN value < 25 THEN 'poor' WHEN value < 50 THEN 'satisfactory' WHEN value < 75 THEN 'good' ELSE 'excellent' END AS band FROM events")
def score_bands(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", scalars.score_band(e.value).alias("band"))


@query("""WITH x AS (SELECT p_partkey, p_partkey * 37 AS files, (p_size % 12)::DOUBLE AS mb, CASE p_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' ELSE 'high' END AS crit FROM part),
 m AS (SELECT *, CAST(floor(CASE WHEN mb > 10 THEN 500 WHEN mb > 5 THEN 1000 ELSE 10000 END * CASE crit WHEN 'low' THEN 1.0 WHEN 'high' THEN 0.2 ELSE 0.5 END) AS BIGINT) AS most FROM x)
 SELECT p_partkey, least(files // greatest(1, files // most), most) AS size FROM m""")
def batch_sizes(spark, d):
    p = table(spark, d, "part")
    crit = F.element_at(F.array(*map(F.lit, ("low", "normal", "high"))), (p.p_partkey % 3 + 1).cast("int"))
    return p.select("p_partkey", scalars.optimal_batch(p.p_partkey * 37, (p.p_size % 12).cast("double"), crit).alias("size"))


@query("SELECT doc_id, round(CAST(n_chars AS DOUBLE) / 4 / 1e6 * CAST(0.0375 AS DOUBLE) + CAST(500 AS DOUBLE) / 1e6 * CAST(0.15 AS DOUBLE), 12) AS cost FROM documents")
def batch_costs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.round(scalars.batch_cost(docs.n_chars / 4.0, F.lit(500)), 12).alias("cost"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS found FROM events")
def json_salvage(spark, d):
    e = table(spark, d, "events")
    obj = e.props
    wrapped = F.when(e.event_id % 4 == 0, obj).when(e.event_id % 4 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(e.event_id % 4 == 2, F.concat(F.lit("Here it is: "), obj, F.lit(". Done"))).otherwise("no json { here")
    return e.select("event_id", F.variant_get(scalars.salvage_json(wrapped), "$.k", "bigint").alias("found"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events")
def json_field(spark, d):
    e = table(spark, d, "events")
    key = F.try_element_at(F.json_object_keys("props"), F.lit(1))
    as_map = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.try_element_at(as_map, key).alias("first"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS code FROM orders")
def category_codes(spark, d):
    o = table(spark, d, "orders")
    codes = o.select("o_orderpriority").distinct().withColumn("code", scalars.category_codes("o_orderpriority", Window.orderBy("o_orderpriority")))
    return o.join(codes, "o_orderpriority").select("o_orderkey", "code")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'error' WHEN doc_id % 7 = 0 THEN 'warning' END AS severity FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def jsonl_validate(spark, d):
    docs = table(spark, d, "documents")
    rid = F.concat(F.lit("r"), docs.doc_id.cast("string"))
    good = F.concat(F.lit('{"request":{"contents":[{"role":"user","parts":[{"fileData":{"fileUri":"gs://b/x"}}]}]},"metadata":{'), F.when(docs.doc_id % 7 != 0, F.concat(F.lit('"request_id":"'), rid, F.lit('"'))).otherwise(""), F.lit("}}"))
    lines = docs.select(F.col("doc_id").alias("line_no"), F.when(docs.doc_id % 3 == 0, F.lit("{broken")).otherwise(good).alias("value"))
    return quality.validate_requests(lines).select(F.col("line_no").alias("doc_id"), "severity")


@query("""SELECT doc_id, quality = 1 AS success, CASE WHEN quality = 1 THEN '{"doc":' || doc_id || '}' END AS parsed FROM labels""")
def parse_results(spark, d):
    labels = table(spark, d, "labels")
    answer = F.concat(F.lit("```json {\\\"doc\\\":"), labels.doc_id.cast("string"), F.lit("} ```"))
    ok = F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"'), answer, F.lit('"}]},"finishReason":"STOP"}]}'))
    line = F.concat(F.lit('{"metadata":{"request_id":"'), labels.doc_id.cast("string"), F.lit('"},"response":'), F.when(labels.quality == 1, ok).otherwise('{"candidates":[]}'), F.lit("}"))
    out = batch.parse_results(labels.select(line.alias("value")))
    return out.select(F.col("request_id").cast("long").alias("doc_id"), "success", "parsed")


@query("SELECT CAST(doc_id AS VARCHAR) AS request_id, CASE WHEN quality = 1 THEN 'completed' ELSE 'submitted' END AS status FROM labels")
def manifest_upsert(spark, d):
    labels = table(spark, d, "labels")
    first = labels.select(F.col("doc_id").cast("string").alias("request_id"), F.lit("submitted").alias("status"), F.lit(1).alias("updated_at"))
    done = labels.filter("quality = 1").select(F.col("doc_id").cast("string").alias("request_id"), F.lit("completed").alias("status"), F.lit(2).alias("updated_at"))
    return batch.upsert(first, done).select("request_id", "status")


@query("SELECT o_orderkey, 'filings/' || o_custkey || '/' || strftime(o_orderdate, '%Y%m%d') || '/' || o_orderkey || '.txt' AS path, 'pending' AS status FROM orders")
def download_plan(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cik"), F.col("o_orderdate").alias("file_date"), F.col("o_orderkey").cast("string").alias("accession_number"))
    return batch.download_plan(o, "filings").select(F.col("accession_number").cast("long").alias("o_orderkey"), "path", "status")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'clean' END, CASE WHEN l.doc_id IS NOT NULL THEN 'archive' END, 'http') AS tier FROM documents d LEFT JOIN labels l USING (doc_id)")
def tiered_text(spark, d):
    docs, labels = tables(spark, d, "documents", "labels")
    text = docs.select("doc_id", "text")
    known = text.join(labels.select("doc_id", "quality"), "doc_id")
    return batch.first_found("doc_id", docs.select("doc_id"), clean=known.filter("quality = 1"), archive=known, http=text).select("doc_id", "tier")


@query("""SELECT 'labels' AS step, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), doc_id, quality, toxic)), 1, 15) AS HUGEINT)) AS VARCHAR) AS checksum FROM labels""")
def step_log(spark, d):
    return batch.step_log(table(spark, d, "labels"), "labels")


@query("SELECT doc_id, CAST(unnest(generate_series(0, greatest(n_chars // 1000 - 1, 0), 50)) AS BIGINT) AS first_page FROM documents")
def page_ranges(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(quality.page_ranges(F.floor(docs.n_chars / 1000), 50)).alias("first_page"))


# Codes are made of each text's digest, so that about one in ten has a right check digit by chance.
_DIGITS = "lpad(CAST(CAST('0x' || substr(md5(text), 1, 14) AS BIGINT) % 10000000000 AS VARCHAR), 10, '0')"


@query(f"""WITH t AS (SELECT doc_id, '978' || {_DIGITS} AS thirteen, {_DIGITS} AS ten FROM documents)
 SELECT doc_id, list_sum(list_transform(generate_series(1, 13), lambda i: CAST(thirteen[i] AS INT) * CASE i % 2 WHEN 1 THEN 1 ELSE 3 END)) % 10 = 0 AS long_valid,
 list_sum(list_transform(generate_series(1, 10), lambda i: CAST(ten[i] AS INT) * (11 - i))) % 11 = 0 AS short_valid FROM t""")
def isbn_check(spark, d):
    docs = table(spark, d, "documents")
    number = F.conv(F.substring(F.md5("text"), 1, 14), 16, 10).cast("bigint") % 10_000_000_000
    digits = F.lpad(number.cast("string"), 10, "0")
    dashed = F.concat(F.lit("978-"), F.left(digits, F.lit(3)), F.lit("-"), F.substring(digits, 4, 7))
    return docs.select("doc_id", scalars.isbn_valid(dashed).alias("long_valid"), scalars.isbn_valid(digits).alias("short_valid"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '10\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+')) AS BIGINT) AS dois,
 CAST(len(regexp_extract_all(text || ' doi:10.1109/PROC.' || doc_id || '.9547 ', '10\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+')) AS BIGINT) AS with_one FROM documents""")
def doi_shapes(spark, d):
    docs = table(spark, d, "documents")
    one = F.concat(F.col("text"), F.lit(" doi:10.1109/PROC."), F.col("doc_id").cast("string"), F.lit(".9547 "))
    return docs.select("doc_id", F.size(scalars.dois(docs.text)).cast("long").alias("dois"), F.size(scalars.dois(one)).cast("long").alias("with_one"))


@query("SELECT r.r_name AS name, n.n_name AS skill FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def registry_lookup(spark, d):
    n, r = tables(spark, d, "nation", "region")
    text = F.concat(F.lit("---\nname: "), n.n_name, F.lit("\ncategory: "), n.n_regionkey.cast("string"), F.lit("\n---\nbody"))
    skills = registry.load(n.select(F.concat(F.lit("/skills/"), n.n_name, F.lit("/SKILL.md")).alias("path"), text.alias("value")))
    return skills.join(r, skills.category.cast("int") == r.r_regionkey).select(F.col("r_name").alias("name"), F.col("name").alias("skill"))


@query("SELECT name, 'personal' AS origin FROM (SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0) UNION ALL SELECT n_name, 'base' FROM nation WHERE n_nationkey % 2 = 1")
def name_shadowing(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return registry.resolve(personal=n.filter("n_nationkey % 2 = 0"), base=n).select("name", "origin")


@query("WITH RECURSIVE t AS (SELECT 0 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 9) SELECT CAST(n AS BIGINT) AS id FROM t")
def inline_frame(spark, d):
    return spark.createDataFrame([(i,) for i in range(10)], "id long")


@query("SELECT 500 AS rows")
def synthetic_rows(spark, d):
    return files.synthetic(spark, 500).agg(F.count("*").cast("int").alias("rows"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY turn DESC, conv_id LIMIT 30")
def newest_first(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn").orderBy(F.col("turn").desc(), "conv_id").limit(30)


@query("SELECT l_suppkey, min(l_shipdate)::DATE AS first, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5", dates=('first',))
def filings_stats(spark, d):
    return sql(spark, "SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS first, count(*) AS n FROM {l} GROUP BY 1 HAVING count(*) > :least", {"least": 5}, l=table(spark, d, "lineitem"))
