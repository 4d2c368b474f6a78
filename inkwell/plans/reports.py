"""Queries that summarise batches, fixes, roles, links, vendors and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import reports as R
from inkwell.operators import statements as S
from inkwell.plans.metrics import LINES, docs
from inkwell.plans.statements import DESCRIBED, ISSUES, SPEC, described, quoted, spec
from inkwell.operators import text as T
from inkwell.registry import query, table

ISSUE = """issues AS (SELECT l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS seq, ['Style', 'Spelling', 'Grammar', 'Punctuation', 'Clarity'][l_partkey % 5 + 1] AS category, ['Critical', 'High', 'Medium', 'Low', 'Info'][l_suppkey % 5 + 1] AS severity,
  CASE WHEN l_linenumber % 2 = 0 THEN 'WORD ' ELSE 'word ' END || l_partkey % 50 AS flagged, CASE WHEN l_partkey % 7 > 0 THEN 'Fix ' || l_partkey % 50 END AS suggestion FROM lineitem)"""


def issues(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    number = (F.col("l_partkey") % 50).cast("string")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), pick("l_partkey", "Style", "Spelling", "Grammar", "Punctuation", "Clarity").alias("category"), pick("l_suppkey", "Critical", "High", "Medium", "Low", "Info").alias("severity"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "WORD ").otherwise("word "), number).alias("flagged"), F.when(F.col("l_partkey") % 7 > 0, F.concat(F.lit("Fix "), number)).alias("suggestion"))


@query("a32_batch_summary", f"WITH {ISSUE} SELECT severity, category, count(*) AS issues, count(DISTINCT doc_id) AS documents FROM issues GROUP BY GROUPING SETS ((severity), (category), ())")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.batch_summary(issues(spark, sf))


@query("a38_fix_groups", f"WITH {ISSUE} SELECT trim(lower(flagged)) AS key, arg_min(flagged, seq) AS flagged, arg_min(suggestion, seq) AS suggestion, count(*) AS n, min(seq) AS first, max(seq) AS last FROM issues WHERE category <> 'Style' AND trim(flagged) <> '' AND trim(suggestion) <> '' GROUP BY trim(lower(flagged)), trim(lower(suggestion)) HAVING count(*) >= 2")
def fix_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.fix_groups(issues(spark, sf))


@query("a39_fix_statistics", f"WITH {ISSUE}, t AS (SELECT *, CASE WHEN suggestion IS NULL OR severity = 'Critical' THEN 'manual' WHEN category IN ('Spelling', 'Punctuation', 'Grammar') AND severity IN ('Low', 'Info', 'Medium') THEN 'safe' ELSE 'review' END AS tier FROM issues) SELECT tier, category, severity, count(*) AS issues, count(suggestion) AS fixable, round(count(suggestion) * 15 / 60.0, 2)::DOUBLE AS review_minutes FROM t GROUP BY GROUPING SETS ((tier), (category), (severity), ())")
def fix_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return R.fix_statistics(issues(spark, sf))


@query("k6_stable_sort", f"WITH {ISSUE} SELECT seq, severity, flagged AS name FROM issues ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, name, seq")
def stable_sort(spark: SparkSession, sf: str) -> DataFrame:
    return R.in_order(issues(spark, sf).select("seq", "severity", F.col("flagged").alias("name")))


@query("a44_roles_from_history", "WITH o AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'ROLE ' ELSE 'Role ' END || l_suppkey AS name, 0.5 + (l_suppkey % 10) / 20.0 AS confidence, CASE WHEN l_orderkey % 3 = 0 THEN 'Unknown' WHEN l_suppkey % 4 > 0 THEN 'Kind ' || l_suppkey % 4 END AS category FROM lineitem) SELECT lower(name) AS name, count(*) AS times, round(avg(confidence), 6)::DOUBLE AS confidence, coalesce(min(category) FILTER (category <> 'Unknown'), 'Unknown') AS category FROM o GROUP BY lower(name) HAVING count(*) >= 2 AND round(avg(confidence), 6) >= 0.7")
def roles_from_history(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("l_suppkey")
    o = table(spark, sf, "lineitem").select(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "ROLE ").otherwise("Role "), s.cast("string")).alias("name"), (0.5 + (s % 10) / 20.0).alias("confidence"), F.when(F.col("l_orderkey") % 3 == 0, "Unknown").when(s % 4 > 0, F.concat(F.lit("Kind "), (s % 4).cast("string"))).alias("category"))
    return R.roles_from_history(o)


@query("a57_learn_corrections", "WITH c AS (SELECT string_split(p_type, ' ')[1] AS was, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN string_split(p_type, ' ')[1] END AS became FROM part) SELECT 'category' AS field, was, became, count(*) AS times FROM c WHERE was IS DISTINCT FROM became GROUP BY ALL HAVING count(*) >= 2")
def learn_corrections(spark: SparkSession, sf: str) -> DataFrame:
    part, kind, third = table(spark, sf, "part"), F.split("p_type", " ")[0], F.col("p_partkey") % 3
    old = part.select(F.col("p_partkey").alias("key"), F.lit("category").alias("field"), kind.alias("value"))
    return R.learned_corrections(old, part.select(F.col("p_partkey").alias("key"), F.lit("category").alias("field"), F.when(third == 0, F.col("p_brand")).when(third == 1, kind).alias("value")))


@query("a59_link_scan_stats", "WITH h AS (SELECT event_type AS source, ts AS scan_time, event_id % 9 AS total, event_id % 9 // 2 AS working FROM events) SELECT source, count(*) AS scans, sum(total)::BIGINT AS links, sum(working)::BIGINT AS working, round(avg(working * 100.0::DOUBLE / nullif(total, 0)), 6) AS success_pct, max(scan_time) AS last FROM h GROUP BY ROLLUP (source)")
def link_scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return R.link_scan_stats(table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("scan_time"), (e % 9).alias("total"), F.floor(e % 9 / 2).alias("working")))


@query("a60_exclusion_stats", "SELECT count(*) AS total, count(*) FILTER (s_suppkey % 3 > 0) AS active, sum(s_nationkey)::BIGINT AS hits, max(s_acctbal) AS last_hit FROM supplier")
def exclusion_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.exclusion_stats(table(spark, sf, "supplier").select((F.col("s_suppkey") % 3 > 0).alias("active"), F.col("s_nationkey").alias("hits"), F.col("s_acctbal").alias("last_hit")))


NAMES = "['Direct labor', 'Fringe benefits', 'Overhead', 'G&A', 'Fixed fee', 'Travel', 'OH rate']"


@query("a68_indirect_rates", f"""WITH i AS (SELECT l_suppkey AS proposal_id, l_orderkey * 10 + l_linenumber AS seq, {NAMES}[l_partkey % 7 + 1] AS description, l_extendedprice * CASE WHEN l_partkey % 7 IN (0, 5) THEN 1 ELSE l_suppkey % 13 END AS amount FROM lineitem),
b AS (SELECT proposal_id, sum(CASE WHEN description = 'Direct labor' THEN amount ELSE 0 END) AS base FROM i GROUP BY 1),
f AS (SELECT proposal_id, r.rate, r.low, r.high, arg_max(amount, seq) AS amount FROM i JOIN (VALUES ('fringe', 'Fringe benefits', 25, 45), ('overhead', 'Overhead', 40, 120), ('overhead', 'OH rate', 40, 120), ('ga', 'G&A', 10, 25), ('fee', 'Fixed fee', 8, 15)) r(rate, name, low, high) ON name = description GROUP BY ALL),
p AS (SELECT proposal_id, rate, amount, low, high, CASE WHEN base > 0 AND amount > 0 THEN round(round(amount / base * 100, 6), 1) END AS implied_pct FROM f JOIN b USING (proposal_id))
SELECT proposal_id, rate, amount, implied_pct, coalesce(implied_pct < low OR implied_pct > high, false) AS outside FROM p""")
def indirect_rates(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("l_partkey") % 7
    amount = F.col("l_extendedprice") * F.when(kind.isin(0, 5), 1).otherwise(F.col("l_suppkey") % 13)
    i = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("proposal_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.element_at(F.expr(NAMES.replace("[", "array(").replace("]", ")")), (kind + 1).cast("int")).alias("description"), amount.alias("amount"))
    return R.indirect_rates(i)


@query("a70_completeness", """WITH i AS (SELECT o_custkey AS proposal_id, count(*) AS n, round((avg((o_orderkey % 5 <> 0)::INTEGER) + avg((o_orderkey % 4 <> 0)::INTEGER) + avg((o_orderpriority <> '1-URGENT')::INTEGER)) / 3 * 100, 6) AS c FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS proposal_id, least(100, c_custkey % 6 * 25) AS tables, least(100, coalesce(n, 0) * 5) AS items, CASE WHEN c_custkey % 3 > 0 THEN 30 ELSE 0 END + 20 + CASE WHEN c_custkey % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 25 ELSE 0 END AS metadata, round(coalesce(c, 0), 1)::DOUBLE AS coverage FROM customer LEFT JOIN i ON proposal_id = c_custkey)
SELECT proposal_id, tables::INTEGER AS tables, items::BIGINT AS items, metadata::INTEGER AS metadata, coverage, round(round(tables * 0.3::DOUBLE + items * 0.3::DOUBLE + metadata * 0.2::DOUBLE + coverage * 0.2::DOUBLE, 6), 1) AS overall FROM s""")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    proposals = table(spark, sf, "customer").select(c.alias("proposal_id"), (c % 6).alias("financial_tables"), F.when(c % 3 > 0, "Firm").alias("company"), F.lit("2024-01-01").alias("date"), F.when(c % 2 == 0, "Base year").alias("term"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("total"))
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("proposal_id"), F.when(o % 4 != 0, "Work").alias("description"), F.when(F.col("o_orderpriority") == "1-URGENT", "Other").otherwise("Labor").alias("category"), F.when(o % 5 != 0, F.col("o_totalprice")).alias("amount"))
    return R.completeness(proposals, items)


@query("a75_active_document_counts", "SELECT l_suppkey AS role_id, count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_orderkey) FILTER (o_orderstatus = 'O') AS active FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def active_document_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "retired").otherwise("superseded")
    return R.active_document_counts(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("role_id"), F.col("l_orderkey").alias("document_id")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), status.alias("status")))


#: An order's lines as a table of four columns with a header row.
CELLS = """cells AS (SELECT l_orderkey AS table_id, l_linenumber AS row, c AS col, [['Part of ' || l_returnflag, CASE WHEN l_orderkey % 3 = 0 THEN 'R' ELSE l_quantity::INTEGER || '' END, '$' || l_extendedprice::INTEGER, '$' || (l_extendedprice::INTEGER + 1)]][1][c + 1] AS value FROM lineitem, range(4) r(c)
  UNION ALL SELECT DISTINCT l_orderkey, 0, c, [CASE WHEN l_orderkey % 2 = 0 THEN 'Role' ELSE 'Item' END, 'Count', 'Each', CASE WHEN l_orderkey % 5 = 0 THEN 'Sum' ELSE 'Total' END][c + 1] FROM lineitem, range(4) r(c))"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    l, o, price = table(spark, sf, "lineitem"), F.col("l_orderkey"), F.round("l_extendedprice").cast("int")
    text = lambda c: F.concat(F.lit("$"), c.cast("string"))
    body = l.select(o.alias("table_id"), F.col("l_linenumber").cast("int").alias("row"), F.posexplode(F.array(F.concat(F.lit("Part of "), "l_returnflag"), F.when(o % 3 == 0, "R").otherwise(F.col("l_quantity").cast("int").cast("string")), text(price), text(price + 1))).alias("col", "value"))
    head = l.select("l_orderkey").distinct().select(o.alias("table_id"), F.lit(0).alias("row"), F.posexplode(F.array(F.when(o % 2 == 0, "Role").otherwise("Item"), F.lit("Count"), F.lit("Each"), F.when(o % 5 == 0, "Sum").otherwise("Total"))).alias("col", "value"))
    return body.unionByName(head)


@query("a76_infer_column_roles", "WITH " + CELLS + r""", p AS (SELECT table_id, col, round(avg(regexp_matches(value, '^\s*\(?[$€£]\s*[\d,]+(?:\.\d+)?\)?\s*$')::INTEGER), 6) AS money, round(avg(regexp_matches(value, '^\s*[\d,]+(?:\.\d+)?\s*$')::INTEGER), 6) AS numbers, round(avg(length(value)), 6) AS width FROM cells WHERE row < 10 GROUP BY ALL),
k AS (SELECT *, CASE WHEN money > 0.5 THEN 'money' WHEN numbers > 0.5 THEN 'number' ELSE 'text' END AS kind FROM p)
SELECT table_id, col::INTEGER AS col, CASE WHEN kind = 'money' AND row_number() OVER (PARTITION BY table_id, kind ORDER BY col DESC) = 1 THEN 'amount' WHEN kind = 'money' AND row_number() OVER (PARTITION BY table_id, kind ORDER BY col DESC) = 2 THEN 'unit_price' WHEN kind = 'number' AND row_number() OVER (PARTITION BY table_id, kind ORDER BY col) = 1 THEN 'quantity'
  WHEN kind = 'text' AND row_number() OVER (PARTITION BY table_id, kind ORDER BY width DESC, col) = 1 THEN 'description' ELSE 'other' END AS role, money, numbers FROM k""")
def infer_column_roles(spark: SparkSession, sf: str) -> DataFrame:
    return R.column_roles(cells(spark, sf))


@query("a76_financial_tables", "WITH " + CELLS + r""", p AS (SELECT table_id, col, sum(regexp_matches(value, '^\s*\(?[$€£]\s*[\d,]+(?:\.\d+)?\)?\s*$')::INTEGER) AS m, count(*) AS n, bool_or(row = 0 AND regexp_matches(value, '(?i)\b(price|cost|amount|total|rate)\b')) AS named FROM cells GROUP BY ALL)
SELECT table_id, bool_or(named) OR sum(m) / sum(n) > 0.45 OR max(m / n) > 0.8 AS financial FROM p GROUP BY 1""")
def financial_tables(spark: SparkSession, sf: str) -> DataFrame:
    return R.financial_tables(cells(spark, sf), share=0.45, column_share=0.8)


@query("t23_roles_from_tables", "WITH " + CELLS + r""", p AS (SELECT table_id, bool_or(row = 0 AND regexp_matches(value, '(?i)\b(role|responsible|owner|position)\b')) AS named, round(avg(regexp_matches(value, '^\s*[RACI](?:\s*/\s*[RACI])?\s*$')::INTEGER) FILTER (row > 0 AND col > 0), 6) AS raci FROM (SELECT * FROM cells WHERE col < 2) GROUP BY 1)
SELECT table_id, trim(value) AS role, CASE WHEN raci > 0.6 THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM cells JOIN p USING (table_id) WHERE row > 0 AND col = 0 AND (named OR raci > 0.6) GROUP BY ALL""")
def roles_from_tables(spark: SparkSession, sf: str) -> DataFrame:
    return R.roles_from_tables(cells(spark, sf).where("col < 2"))


@query("a78_comparison_history", "SELECT o_orderkey AS comparison_id, c_name AS project, 2 AS vendors, o_totalprice AS total, (o_custkey % 50)::DOUBLE AS spread, o_orderdate AS created FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def comparison_history(spark: SparkSession, sf: str) -> DataFrame:
    result = F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("vendors"), F.col("o_totalprice").alias("total"), (F.col("o_custkey") % 50).cast("double").alias("spread")))
    saved = table(spark, sf, "orders").select(F.col("o_orderkey").alias("comparison_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created"), result.alias("result"))
    return R.comparison_history(saved, table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project")), 100)


VARIANTS = (("Crew", "crew"), ("Crew", "the crew"), ("Helper", "assistant"), ("Lead", "should perform"), ("Lead", "us"))
_VARIANTS = "v(canonical, variant) AS (VALUES " + ", ".join(map(str, VARIANTS)) + ")"
MAPPED = f"""{DESCRIBED}, {_VARIANTS}, w AS (SELECT conv_id * 100 + turn AS id, list_transform(regexp_extract_all(description, '[a-zA-Z0-9]+'), lambda x: lower(x)) AS w FROM stmts),
g AS (SELECT id, unnest(w) AS g FROM w UNION SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w)),
m AS (SELECT id AS statement_id, canonical, min(how) AS how FROM (SELECT id, canonical, 'text' AS how FROM g JOIN v ON variant = g AND length(variant) >= 3 UNION ALL SELECT conv_id * 100 + turn, canonical, 'explicit' FROM stmts JOIN v ON lower(role) = variant) GROUP BY ALL)"""


def mapped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = described(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("statement_id"), "role", F.col("description").alias("text"))
    return s, R.statements_of_roles(s, spark.createDataFrame(VARIANTS, "canonical string, variant string"))


@query("j11_statements_to_roles", f"WITH {MAPPED} SELECT statement_id, canonical, how FROM m")
def statements_to_roles(spark: SparkSession, sf: str) -> DataFrame:
    return mapped(spark, sf)[1]


@query("j11_unmapped", f"WITH {MAPPED} SELECT count(*) AS statements, count(*) FILTER (conv_id * 100 + turn IN (SELECT statement_id FROM m)) AS mapped, round(count(*) FILTER (conv_id * 100 + turn IN (SELECT statement_id FROM m)) * 100.0::DOUBLE / count(*), 6) AS coverage_pct FROM stmts")
def unmapped(spark: SparkSession, sf: str) -> DataFrame:
    return R.unmapped(*mapped(spark, sf))


@query("j12_strict_role_scan", "SELECT doc_id, v.name, w.pos - 1 AS pos FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9]+') AS w FROM documents)) w JOIN (VALUES ('The'), ('maison')) v(name) ON lower(word) = lower(v.name)")
def strict_role_scan(spark: SparkSession, sf: str) -> DataFrame:
    return R.role_positions(docs(spark, sf), spark.createDataFrame([("The",), ("maison",)], "name string")).withColumn("pos", F.col("pos").cast("long"))


@query("j13_canonicalise", "SELECT p_partkey AS id, p_type AS name, CASE WHEN lower(p_type) = 'promo steel' THEN 'Promotion' ELSE array_to_string(list_transform(string_split(p_type, ' '), lambda x: CASE lower(x) WHEN 'economy' THEN 'Eco' WHEN 'steel' THEN 'Fe' ELSE x END), ' ') END AS canonical FROM part")
def canonicalise(spark: SparkSession, sf: str) -> DataFrame:
    aliases = spark.createDataFrame([("Promo Steel", "Promotion"), ("ECONOMY", "Eco"), ("steel", "Fe")], "alias string, canonical string")
    return R.canonicalised(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")), aliases)


@query("j20_sentence_cooccurrence", "WITH h AS (SELECT DISTINCT l_orderkey AS d, l_linenumber % 2 AS s, l_suppkey % 30 AS r FROM lineitem), n AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM h a JOIN h b ON a.d = b.d AND a.s = b.s AND a.r < b.r GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, n, n * 0.5::DOUBLE AS weight FROM n ANTI JOIN (SELECT least(n_nationkey, n_regionkey) AS a, greatest(n_nationkey, n_regionkey) AS b FROM nation) USING (a, b)")
def sentence_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("sent_idx"), (F.col("l_suppkey") % 30).alias("role"))
    return R.sentence_pairs(hits, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source"), F.col("n_regionkey").cast("long").alias("target")))


RELATIONS = (("instructs", r"(?i)the (\w+) should (\w+)"), ("may", r"(?i)each (\w+) may (\w+)"))


@query("j21_typed_relationships", f"WITH {SPEC}, e AS (" + " UNION ALL ".join(f"SELECT '{t}' AS type, lower(regexp_extract(text, '{p}', 1)) AS source, lower(regexp_extract(text, '{p}', 2)) AS target FROM spec" for t, p in RELATIONS) + ") SELECT type, source, target, count(*) AS n FROM e WHERE source <> '' AND target <> '' GROUP BY ALL")
def typed_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return R.typed_relationships(spec(spark, sf), RELATIONS)


@query("j23_detect_category", "SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'ENGR' WHEN 1 THEN 'QA' WHEN 2 THEN 'SUPPLIER' END AS code FROM supplier WHERE s_suppkey % 4 < 3")
def detect_category(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    name = F.when(s % 4 == 0, "QA-engr12 plan").when(s % 4 == 1, "Doc_qa.7").when(s % 4 == 2, F.col("s_name")).otherwise("none 12")
    return R.detected_category(table(spark, sf, "supplier").select(s.alias("doc_id"), name.alias("name")), spark.createDataFrame([("QA",), ("ENGR",), ("SUPPLIER",), ("QAX",)], "code string"))


@query("j25_cross_functional", "SELECT s_nationkey % 5 AS owner, o_custkey % 5 AS function, count(DISTINCT l_suppkey) AS roles, count(*) AS mentions FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE s_nationkey % 5 <> o_custkey % 5 GROUP BY ALL")
def cross_functional(spark: SparkSession, sf: str) -> DataFrame:
    mentions = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("role_id"), F.col("l_orderkey").alias("document_id"), F.lit(1).alias("mention_count"))
    return R.cross_functional(mentions, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("role_id"), (F.col("s_nationkey") % 5).alias("owner")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 5).alias("function")))


@query("j30_role_context", "SELECT l_orderkey AS document_id, 'Role-' || l_suppkey AS role, count(*) AS mention_count FROM lineitem WHERE l_suppkey = 7 GROUP BY ALL")
def role_context(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("Role-"), F.col("l_suppkey").cast("string")).alias("role")).agg(F.count("*").alias("mention_count"))
    return R.role_context(m, "role 7")


@query("r16_documents_by_source", "SELECT page_id AS document_id, url AS source_url, page_id * 37 % 1000 AS last_scan FROM pages WHERE url ILIKE '%.COM/%'")
def documents_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return R.documents_by_source(table(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("source_url"), (F.col("page_id") * 37 % 1000).alias("last_scan")), "%.COM/%")


@query("r17_validated_hits", f"WITH {LINES}, h AS (SELECT *, CASE para_idx % 4 WHEN 0 THEN substr(text, 3, 5) WHEN 1 THEN upper(regexp_replace(substr(text, 3, 5), '[^a-z]', '.', 'g')) WHEN 2 THEN substr(text, 1, 4) ELSE 'never there' END AS flagged FROM lines WHERE length(text) > 10) SELECT doc_id, para_idx::INTEGER AS para_idx, 2 AS start, flagged, CASE WHEN substr(text, 3, length(flagged)) = flagged THEN 'exact' WHEN lower(substr(text, 3, length(flagged))) = lower(flagged) THEN 'case' ELSE 'moved' END AS found FROM h WHERE contains(lower(text), lower(flagged))")
def validated_hits(spark: SparkSession, sf: str) -> DataFrame:
    paras = T.paragraphs(docs(spark, sf))
    part = F.substring("text", 3, 5)
    k = F.col("para_idx") % 4
    flagged = F.when(k == 0, part).when(k == 1, F.upper(F.regexp_replace(part, "[^a-z]", "."))).when(k == 2, F.substring("text", 1, 4)).otherwise("never there")
    return R.validated_hits(paras.where(F.length("text") > 10).select("doc_id", "para_idx", F.lit(2).alias("start"), flagged.alias("flagged")), paras)


@query("r19_metric_thresholds", "WITH m AS (SELECT doc_id, 'chars' AS metric, length(text)::DOUBLE AS value FROM documents UNION ALL SELECT doc_id, 'id', doc_id FROM documents) SELECT doc_id, metric, value, CASE WHEN value < low THEN 'too_low' ELSE 'too_high' END AS issue FROM m JOIN (VALUES ('chars', 500.0::DOUBLE, 2000.0::DOUBLE), ('id', 10.0::DOUBLE, 1e9::DOUBLE)) t(metric, low, high) USING (metric) WHERE value < low OR value > high")
def metric_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    m = docs(spark, sf).select("doc_id", F.inline(F.array(F.struct(F.lit("chars").alias("metric"), F.length("text").cast("double").alias("value")), F.struct(F.lit("id").alias("metric"), F.col("doc_id").cast("double").alias("value")))))
    return R.outside_targets(m, spark.createDataFrame([("chars", 500.0, 2000.0), ("id", 10.0, 1e9)], "metric string, low double, high double"))


GROUPS = (("article", "the"), ("article", "la"), ("article", "le"), ("join", "and"), ("join", "et"), ("join", "to"))


@query("g8_concept_synonyms", f"WITH w AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x))) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, grp AS \"group\", string_agg(term, ',' ORDER BY term) AS members, sum(n)::BIGINT AS n FROM c JOIN (VALUES {', '.join(map(str, GROUPS))}) v(grp, term) USING (term) GROUP BY ALL HAVING count(*) > 1")
def concept_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    return R.concept_synonyms(docs(spark, sf), spark.createDataFrame(GROUPS, "group string, term string"))


ROWS = "s_name || ' ; ' || CASE WHEN s_suppkey % 2 = 0 THEN '[S] Tool ' ELSE 'Role ' END || s_nationkey || ';;Role ' || s_suppkey % 7"


def sipoc(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.expr(ROWS).alias("resources"), F.expr("'level: ' || s_suppkey % 3 || '; kind: a:b;none'").alias("attributes"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN ' Yes' ELSE 'no' END").alias("flag"))
    return R.parse_sipoc(rows)


_PARSED = f"r AS (SELECT s_suppkey, string_split({ROWS}, ';') AS i FROM supplier), p AS (SELECT s_suppkey, generate_subscripts(i, 1) - 1 AS place, trim(unnest(i)) AS item FROM r), q AS (SELECT s_suppkey AS row_id, place::INTEGER AS place, CASE WHEN starts_with(item, '[S] ') THEN 'tool' ELSE 'role' END AS kind, replace(item, '[S] ', '') AS name FROM p WHERE item <> '')"


@query("f12_parse_sipoc", f"WITH {_PARSED} SELECT *, row_id % 3 || '|a:b' AS attributes, row_id % 3 = 0 AS active FROM q")
def parse_sipoc(spark: SparkSession, sf: str) -> DataFrame:
    return sipoc(spark, sf).withColumn("attributes", F.concat_ws("|", F.col("attributes")["level"], F.col("attributes")["kind"]))


@query("g9_import_hierarchy", f"WITH {_PARSED}, f AS (SELECT row_id, arg_min(name, place) AS source, min(place) AS first FROM q WHERE kind = 'role' GROUP BY 1) SELECT DISTINCT source, name AS target, CASE kind WHEN 'tool' THEN 'uses-tool' ELSE 'inherits-from' END AS type FROM q JOIN f USING (row_id) WHERE place <> first")
def import_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return R.sipoc_edges(sipoc(spark, sf))


FIXES = ((r"\be\.g\.", "for example"), (r"\bdon't\b", "do not"), (r"\bin order to\b", "to"), (r"\bthe the\b", "the"))


@query("f7_apply_fixes", "SELECT doc_id, md5(" + "regexp_replace(" * len(FIXES) + "text || ' e.g. we don''t stop in order to rest'" + "".join(f", '{quoted(a)}', '{b}', 'g')" for a, b in FIXES) + ") AS text_md5 FROM (SELECT doc_id, regexp_replace(text, '[^\\x01-\\x7F]', '_', 'g') AS text FROM documents)")
def apply_fixes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.regexp_replace("text", r"[^\x01-\x7F]", "_"), F.lit(" e.g. we don't stop in order to rest"))
    return docs(spark, sf).select("doc_id", F.md5(R.apply_fixes(text, FIXES)).alias("text_md5"))


@query("f9_contract_facts", "SELECT s_suppkey, ['Base Year', 'Option Period 2', '24 months', NULL][s_suppkey % 4 + 1] AS term, CASE WHEN s_suppkey % 3 > 0 THEN 'Acme Works ' || ['Inc', 'LLC', 'GmbH'][s_suppkey % 3 + 1] END AS company, ['2024-01-05', 'March 3, 2025', '1/2/24', NULL, NULL][s_suppkey % 5 + 1] AS date FROM supplier")
def contract_facts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    pick = lambda n, *of: F.element_at(F.array(*map(F.lit, of)), (s % n + 1).cast("int"))
    text = F.concat(F.lit("offer by "), F.when(s % 3 > 0, F.concat(F.lit("Acme Works "), pick(3, "Inc", "LLC", "GmbH"))).otherwise("nobody"), F.lit(" for the "), pick(4, "Base Year", "Option Period 2", "24 months", "work"), F.lit(" of "), pick(5, "2024-01-05", "March 3, 2025", "1/2/24", "May", "99"))
    term, company, date = R.contract_facts(text)
    return table(spark, sf, "supplier").select("s_suppkey", term.alias("term"), company.alias("company"), date.alias("date"))


KINDS = (("Quality", r"quality|qm"), ("Small", "economy|small"), ("Large", "large|promo"))


@query("f11_role_category", "SELECT CASE WHEN regexp_matches(lower(p_type), 'economy|small') THEN 'Small' WHEN regexp_matches(lower(p_type), 'large|promo') THEN 'Large' ELSE 'Unknown' END AS category, count(*) AS parts FROM part GROUP BY 1")
def role_category(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(R.role_category(F.col("p_type"), KINDS).alias("category")).agg(F.count("*").alias("parts"))


_NAMED = f"{SPEC}, named AS (SELECT doc_id, para_idx, CASE para_idx % 3 WHEN 0 THEN 'The Test Quality Report and Flight Plan of the Quality Manager ' WHEN 1 THEN 'Each Crew sends Crew Manager lists to the Safety Plan ' ELSE '' END || lower(text) AS text FROM spec)"


def named(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("para_idx") % 3
    return spec(spark, sf).withColumn("text", F.concat(F.when(k == 0, "The Test Quality Report and Flight Plan of the Quality Manager ").when(k == 1, "Each Crew sends Crew Manager lists to the Safety Plan ").otherwise(""), F.lower("text")))


@query("t18_extract_deliverables", f"WITH {_NAMED} SELECT doc_id, para_idx, name, CASE WHEN regexp_matches(lower(name), 'quality|qm') THEN 'Quality' ELSE 'Unknown' END AS kind FROM (SELECT doc_id, para_idx, unnest(list_distinct(regexp_extract_all(text, '(?:[A-Z][A-Za-z]+ )+(?:Report|Plan|Specification|Manual|List|Schedule)'))) AS name FROM named)")
def deliverables(spark: SparkSession, sf: str) -> DataFrame:
    return R.deliverables(named(spark, sf), KINDS)


@query("t17_extract_role_mentions", f"WITH {_NAMED}, h AS (SELECT doc_id, para_idx, regexp_replace(unnest(regexp_extract_all(text, '(?:[A-Z][A-Za-z]+ )*(?:Manager|Crew)')), '^(?:The|A|An|See|Each|Of) ', '') AS name FROM named) SELECT doc_id, para_idx, CASE lower(name) WHEN 'quality manager' THEN 'QM' ELSE name END AS role, count(*) AS n FROM h GROUP BY ALL")
def role_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return R.role_mentions(named(spark, sf), ("Manager", "Crew"), spark.createDataFrame([("Quality Manager", "QM")], "alias string, canonical string"))


@query("t22_schwartz_hearst", "SELECT s_suppkey, ['Big Red Car', NULL, NULL, 'Hot Cup Idea'][s_suppkey % 4 + 1] AS long_form FROM supplier")
def schwartz_hearst(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *of: F.element_at(F.array(*map(F.lit, of)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    before = F.concat("s_name", F.lit(" in "), pick("Big Red Car ", "Failure Modes and Effects Analysis ", "no such words ", "a Hot Cup Idea, "))
    return table(spark, sf, "supplier").select("s_suppkey", R.long_form(pick("BRC", "FMEA", "XYZ", "HCI"), before).alias("long_form"))


@query("a34_compliance_score", f"WITH {ISSUES}, bad AS (SELECT DISTINCT doc_id, para_idx FROM found WHERE n > 0) SELECT doc_id, count(*) AS requirements, count(*) FILTER (b.para_idx IS NULL) AS clean, round(count(*) FILTER (b.para_idx IS NULL) * 100.0::DOUBLE / count(*), 6) AS score FROM reqs LEFT JOIN bad b USING (doc_id, para_idx) GROUP BY doc_id")
def compliance_score(spark: SparkSession, sf: str) -> DataFrame:
    reqs = S.requirements(spec(spark, sf))
    return R.standard_scores(reqs, S.requirement_issues(reqs))
