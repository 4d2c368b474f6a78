"""Queries of operators whose features the documents lack, over the specification made from them, and of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import rules as R
from inkwell.operators import terms as E
from inkwell.operators import text as T
from inkwell.plans.metrics import KNOWN, TOKENS, docs
from inkwell.plans.reports import ISSUE, issues
from inkwell.plans.statements import SPEC, spec
from inkwell.registry import query, table
from inkwell.sources import files


@query("t7_syllables", rf"WITH {TOKENS} SELECT word, y::INTEGER AS syllables, count(*) AS n FROM (SELECT word, {KNOWN} AS y FROM (SELECT word, regexp_replace(word, '[^a-z]', '', 'g') AS b FROM tokens)) GROUP BY ALL")
def syllables(spark: SparkSession, sf: str) -> DataFrame:
    return T.tokens(docs(spark, sf)).groupBy("word").agg(F.count("*").alias("n")).select("word", X.syllables(F.col("word")).alias("syllables"), "n")


_NUMBERED, _MARKED, _CAPITALS = r"^\s*(\d+(?:\.\d+)*)\.?\s+([A-Z].*)$", r"^#{1,6}\s+(.+)$", "^[A-Z][A-Z0-9 ,&/-]{4,}$"
HEADS = rf"""heads AS (SELECT *, CASE WHEN number IS NOT NULL THEN trim(regexp_extract(text, '{_NUMBERED}', 2)) WHEN regexp_matches(text, '{_MARKED}') THEN trim(regexp_extract(text, '{_MARKED}', 1)) WHEN regexp_matches(text, '{_CAPITALS}') THEN trim(text) END AS title FROM (SELECT *, CASE WHEN regexp_matches(text, '{_NUMBERED}') THEN regexp_extract(text, '{_NUMBERED}', 1) END AS number FROM spec))"""


@query("t8_detect_heading", f"WITH {SPEC}, {HEADS} SELECT doc_id, para_idx, number, md5(title) AS title_md5 FROM heads WHERE title IS NOT NULL")
def detect_heading(spark: SparkSession, sf: str) -> DataFrame:
    number, title = T.heading(F.col("text"))
    return spec(spark, sf).select("doc_id", "para_idx", number.alias("number"), F.md5(title).alias("title_md5")).where("title_md5 is not null")


@query("t9_assign_sections", f"WITH {SPEC}, {HEADS} SELECT doc_id, para_idx, md5(coalesce(last_value(CASE WHEN title IS NOT NULL THEN concat_ws(' ', number, title) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING), '')) AS section_md5 FROM heads")
def assign_sections(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_sections(spec(spark, sf)).select("doc_id", "para_idx", F.md5("section").alias("section_md5"))


_REF = r"(?i)\b(section|table|figure|appendix)\s+([0-9]+(?:\.[0-9]+)*|[A-Z])\b"
#: The specification's lines as one text a document; `See` lines refer to sections, numbered lines are sections.
PARTS = rf"""whole AS (SELECT doc_id, string_agg(regexp_replace(text, '[^\x01-\x7F]', '_', 'g'), chr(10) ORDER BY para_idx) AS text FROM spec GROUP BY 1), hits AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_REF}')) AS hit FROM whole),
refs AS (SELECT doc_id, lower(regexp_extract(hit, '{_REF}', 1)) AS kind, regexp_extract(hit, '{_REF}', 2) AS ref_id FROM hits), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM whole),
items AS (SELECT DISTINCT doc_id, 'section' AS kind, regexp_extract(line, '^\s*([0-9]+(?:\.[0-9]+)*)\.?\s+[A-Z]', 1) AS ref_id FROM lines WHERE regexp_matches(line, '^\s*([0-9]+(?:\.[0-9]+)*)\.?\s+[A-Z]')
  UNION SELECT doc_id, lower(regexp_extract(line, '(?i)^\s*(table|figure|appendix)\s+([0-9]+(?:\.[0-9]+)*|[A-Z])\s*[:.–-]', 1)), regexp_extract(line, '(?i)^\s*(table|figure|appendix)\s+([0-9]+(?:\.[0-9]+)*|[A-Z])\s*[:.–-]', 2) FROM lines WHERE regexp_matches(line, '(?i)^\s*(table|figure|appendix)\s+([0-9]+(?:\.[0-9]+)*|[A-Z])\s*[:.–-]'))"""


def whole(spark: SparkSession, sf: str) -> DataFrame:
    lines = spec(spark, sf).withColumn("text", F.regexp_replace("text", r"[^\x01-\x7F]", "_"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query("t20_extract_references", f"WITH {SPEC}, {PARTS} SELECT doc_id, kind, ref_id, count(*) AS n FROM refs GROUP BY ALL")
def extract_references(spark: SparkSession, sf: str) -> DataFrame:
    return E.extract_references(whole(spark, sf)).groupBy("doc_id", "kind", "ref_id").agg(F.count("*").alias("n"))


@query("j6_broken_references", f"WITH {SPEC}, {PARTS} SELECT doc_id, kind, ref_id, count(*) AS n FROM refs ANTI JOIN items USING (doc_id, kind, ref_id) GROUP BY ALL")
def broken_references(spark: SparkSession, sf: str) -> DataFrame:
    w = whole(spark, sf)
    return E.broken_references(E.extract_references(w), E.extract_defined_items(w)).groupBy("doc_id", "kind", "ref_id").agg(F.count("*").alias("n"))


@query("j7_unreferenced_items", f"WITH {SPEC}, {PARTS} SELECT doc_id, kind, ref_id FROM items ANTI JOIN refs USING (doc_id, kind, ref_id)")
def unreferenced_items(spark: SparkSession, sf: str) -> DataFrame:
    w = whole(spark, sf)
    return E.unreferenced_items(E.extract_defined_items(w), E.extract_references(w))


@query("j4_acronym_status", r"""WITH d AS (SELECT l_orderkey AS doc_id, 'A' || l_partkey % 9 AS acronym, count(DISTINCT l_suppkey % 2) AS expansions FROM lineitem WHERE l_linenumber = 1 OR l_suppkey % 5 = 0 GROUP BY ALL), u AS (SELECT l_orderkey AS doc_id, 'A' || l_partkey % 9 AS acronym, count(*) AS uses FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
SELECT doc_id, acronym, coalesce(uses, 0) AS uses, CASE WHEN expansions > 1 THEN 'INCONSISTENT' WHEN expansions = 1 THEN 'DEFINED' WHEN acronym IN ('A1', 'A2') THEN 'KNOWN' ELSE 'UNDEFINED' END AS status FROM u FULL JOIN d USING (doc_id, acronym)""")
def acronym_status(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    named = lambda where, *more: l.where(where).select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("A"), (F.col("l_partkey") % 9).cast("string")).alias("acronym"), *more)
    return E.acronym_status(named("l_linenumber = 1 OR l_suppkey % 5 = 0", (F.col("l_suppkey") % 2).cast("string").alias("expansion")), named("l_linenumber > 1"), spark.createDataFrame([("A1",), ("A2",)], "acronym string"))


_ID = "'ISS-' || substr(md5(concat_ws('|', seq, category, severity, substr(flagged, 1, 100), substr(flagged, 1, 50))), 1, 12)"


@query("f1_issue_id", f"WITH {ISSUE} SELECT {_ID} AS issue_id, substr(md5(trim(regexp_replace(lower(flagged), '[ \\t\\n\\r]+', ' ', 'g'))), 1, 16) AS fingerprint, seq FROM issues")
def issue_id(spark: SparkSession, sf: str) -> DataFrame:
    i = issues(spark, sf)
    return i.select(X.issue_id(F.col("seq"), F.col("category"), F.col("severity"), F.col("flagged"), F.col("flagged")).alias("issue_id"), X.fingerprint(F.col("flagged")).alias("fingerprint"), "seq")


def stated(spark: SparkSession, sf: str) -> DataFrame:
    return issues(spark, sf).select("doc_id", F.col("seq").alias("para_idx"), "category", "severity", F.col("flagged").alias("message"), "flagged")


@query("j10_suppress_baselined", f"WITH {ISSUE}, b AS (SELECT DISTINCT doc_id, {_ID} AS issue_id FROM issues WHERE seq % 3 = 0) SELECT doc_id, seq AS para_idx, category FROM (SELECT *, {_ID} AS issue_id FROM issues) ANTI JOIN b USING (doc_id, issue_id)")
def suppress_baselined(spark: SparkSession, sf: str) -> DataFrame:
    s = stated(spark, sf)
    accepted = s.where("para_idx % 3 = 0").select("doc_id", X.issue_id(F.col("para_idx"), F.col("category"), F.col("severity"), F.col("message"), F.col("flagged")).alias("issue_id"))
    return R.suppress_baselined(s, accepted).select("doc_id", "para_idx", "category")


@query("j27_learned_overrides", f"WITH {ISSUE}, o AS (SELECT *, CASE category WHEN 'Style' THEN 'Info' WHEN 'Grammar' THEN 'High' ELSE severity END AS learned FROM issues) SELECT category, learned AS severity, count(*) AS issues FROM o GROUP BY ALL")
def learned_overrides(spark: SparkSession, sf: str) -> DataFrame:
    dismissed = spark.createDataFrame([("Style", 3), ("Clarity", 1)], "category string, times int")
    given = spark.createDataFrame([("Grammar", "High", 5), ("Grammar", "Low", 4), ("Spelling", "Low", 1)], "category string, severity string, times int")
    return R.learned_overrides(stated(spark, sf), dismissed, given).groupBy("category", "severity").agg(F.count("*").alias("issues"))


@query("r14_enabled_rules", "SELECT p_brand AS pack, count(*) AS rules, count(*) FILTER (p_partkey % 5 = 0 OR p_brand = 'Brand#2') AS high FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1")
def enabled_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = table(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("pack"), F.when(F.col("p_partkey") % 5 == 0, "High").otherwise("Low").alias("severity"))
    preset = spark.createDataFrame([("Brand#1", False, None), ("Brand#2", True, "High"), ("Brand#3", True, None)], "pack string, enabled boolean, severity string")
    return R.enabled_rules(rules, preset).groupBy("pack").agg(F.count("*").alias("rules"), F.count_if(F.col("severity") == "High").alias("high"))


@query("f4_jaccard", r"WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS a, lead(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) AS jaccard FROM w WHERE b IS NOT NULL")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    from inkwell.plans.matching import turns

    return turns(spark, sf).select("conv_id", "turn", F.round(X.jaccard(F.split("old", " "), F.split("new", " ")), 9).alias("jaccard"))


@query("f10_context", f"WITH {SPEC} SELECT doc_id, para_idx, substr(text, greatest(p - 40, 1), p + 4 + 40 - greatest(p - 40, 1)) AS context FROM (SELECT *, instr(text, 'crew') AS p FROM spec) WHERE p > 0")
def context(spark: SparkSession, sf: str) -> DataFrame:
    at = F.locate("crew", F.col("text"))
    return spec(spark, sf).where(at > 0).select("doc_id", "para_idx", X.context(F.col("text"), at, F.lit(4)).alias("context"))


@query("s2_discover_files")
def discover_files(spark: SparkSession, sf: str) -> DataFrame:
    return files.discover_files(spark, sf, ("parquet",))


@query("s9_write_issues", f"WITH {ISSUE} SELECT severity, category, count(*) AS issues FROM issues WHERE severity IN ('High', 'Medium') AND category IN ('Style', 'Grammar') GROUP BY ALL")
def write_issues(spark: SparkSession, sf: str) -> DataFrame:
    return files.chosen_issues(issues(spark, sf), ("High", "Medium"), ("Style", "Grammar")).groupBy("severity", "category").agg(F.count("*").alias("issues"))


@query("s11_write_link_results", "SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'WORKING' WHEN page_id % 5 = 0 THEN 'BROKEN' ELSE 'TIMEOUT' END AS status FROM pages")
def write_link_results(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    made = table(spark, sf, "pages").select("page_id", F.when(p % 5 == 0, "BROKEN").otherwise("TIMEOUT").alias("status"), (p % 3 == 0).alias("excluded"), F.when(p % 7 > 0, p % 2 == 0).otherwise(F.when(p % 2 == 0, True)).alias("treat_as_valid"))
    return files.shown_links(made).select("page_id", "status")
