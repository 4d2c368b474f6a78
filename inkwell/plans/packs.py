"""Queries that apply every rule pack to every paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import packs as P
from inkwell.operators import text as T
from inkwell.operators.rules import SAME_CATEGORY, SEVERITY_WEIGHTS, SUMMARY_WEIGHTS
from inkwell.operators.rules import document_summary as document_summary_of
from inkwell.plans.metrics import LINES, docs
from inkwell.plans.review import REVIEW
from inkwell.plans.statements import SPEC, spec
from inkwell.registry import query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pack_sql(p: P.Pack, of: str) -> str:
    text = f"regexp_replace(t, {quoted(P.whole_words(p.without))}, '_', 'g')" if p.without else "t"
    tests = [f"regexp_matches(t, {quoted(p.only)})"] * bool(p.only) + [f"NOT regexp_matches(t, {quoted(p.never)})"] * bool(p.never)
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    category = SAME_CATEGORY.get(p.category.lower(), p.category.lower())
    return f"SELECT doc_id, para_idx, {quoted(p.name)} AS pack, {quoted(category)} AS category, {quoted(p.severity)} AS standard, regexp_extract_all({text}, {quoted(p.regex())}) AS h FROM {of}{where}"


_OWN = ", ".join(f"({quoted(p.name)}, {quoted(k)}, {quoted(s)}, {quoted(to)})" for p in P.PACKS for k, (to, s) in p.entries().items())


def scan_sql(of: str) -> str:
    every = " UNION ALL ".join(pack_sql(p, "flat") for p in P.PACKS)
    return rf"""flat AS (SELECT doc_id, para_idx, lower(regexp_replace(text, '[^\x01-\x7F]', '_', 'g')) AS t FROM {of}), own(pack, hit, own, replacement) AS (VALUES {_OWN}),
found AS (SELECT doc_id, para_idx, pack, category, standard, unnest(h) AS hit, generate_subscripts(h, 1) - 1 AS hit_idx FROM ({every})),
pack_hits AS (SELECT doc_id, para_idx, pack, category, hit_idx, hit, coalesce(own, standard) AS severity, coalesce(replacement, '') AS replacement FROM found LEFT JOIN own USING (pack, hit))"""


@query("r1_rule_packs", f"WITH {LINES}, {scan_sql('lines')} SELECT doc_id, pack, severity, count(*) AS hits, count(DISTINCT hit) AS texts, count(*) FILTER (replacement <> '') AS replaced, min(para_idx)::BIGINT AS first_para FROM pack_hits GROUP BY ALL")
def rule_packs(spark: SparkSession, sf: str) -> DataFrame:
    found = P.pack_scan(T.paragraphs(docs(spark, sf)))
    return found.groupBy("doc_id", "pack", "severity").agg(F.count("*").alias("hits"), F.countDistinct("hit").alias("texts"), F.count_if(F.col("replacement") != "").alias("replaced"), F.min("para_idx").cast("long").alias("first_para"))


_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SEVERITY_WEIGHTS.items()) + " END"


@query("review_all_packs", rf"""WITH {REVIEW}, {scan_sql('clean')},
packed AS (SELECT * FROM pack_hits QUALIFY row_number() OVER (PARTITION BY doc_id, para_idx, category, substr(hit, 1, 80) ORDER BY hit_idx) = 1),
both_kinds AS (SELECT doc_id, para_idx, spot, category, weight FROM once UNION ALL SELECT doc_id, para_idx, hit_idx, category, {_WEIGHT} FROM packed),
t AS (SELECT doc_id, weight * CASE WHEN i = 1 THEN 1.0 ELSE 1 / ln(i + 1) END AS takes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY para_idx, spot) AS i FROM both_kinds)),
per AS (SELECT doc_id, count(*) AS n, round(sum(takes), 9) AS takes FROM t GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS issues, floor(100 - least(80.0, coalesce(CASE WHEN n > 20 THEN takes / log10(n + 1) ELSE takes END, 0) / 2))::INTEGER AS score FROM documents LEFT JOIN per USING (doc_id))
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM scored""")
def review_all_packs(spark: SparkSession, sf: str) -> DataFrame:
    return P.full_review(docs(spark, sf))


_SUMMED = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SUMMARY_WEIGHTS.items()) + " ELSE 1 END"


@query("a31_document_summary", rf"""WITH {LINES}, {scan_sql('lines')},
per AS (SELECT doc_id, count(*) AS n, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (replacement NOT IN ('', '-')) AS fixable, round(sum({_SUMMED}), 1) AS weighted, count(DISTINCT para_idx) AS marked FROM pack_hits GROUP BY 1),
kinds AS (SELECT doc_id, category, count(*) AS n FROM pack_hits GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, category) <= 3),
best AS (SELECT doc_id, string_agg(category || ' ' || n, ', ' ORDER BY n DESC, category) AS top FROM kinds GROUP BY 1),
sizes AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+(?:''[a-zA-Z]+)?')) AS words, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p) <> '')) AS paras FROM documents)
SELECT doc_id, coalesce(n, 0) AS issues, coalesce(critical, 0) AS critical, coalesce(fixable, 0) AS fixable, coalesce(weighted, 0.0)::DOUBLE AS weighted, round(coalesce(n, 0) / greatest(words, 1)::DOUBLE * 1000, 2) AS density, coalesce(marked, 0) AS paragraphs_with_issues, paras - coalesce(marked, 0) AS clean_paragraphs, coalesce(top, '') AS top
FROM sizes LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id)""")
def document_summary(spark: SparkSession, sf: str) -> DataFrame:
    texts = docs(spark, sf)
    return document_summary_of(P.pack_scan(T.paragraphs(texts)).withColumnRenamed("replacement", "suggestion"), texts)


#: The specification's lines, some with wide spaces and splices.
_WIDE = "wide AS (SELECT doc_id, para_idx, CASE para_idx % 5 WHEN 0 THEN '  ' || replace(text, ' ', '  ') WHEN 1 THEN replace(text, ' of ', ', it runs of ') WHEN 2 THEN replace(text, '. ', ', however ') WHEN 3 THEN '4.1  ' || text || '  end' ELSE text END AS text FROM spec)"
_SPLICE = ", ".join(rf"nullif(regexp_extract(lower(regexp_replace(text, '[^\x01-\x7F]', '_', 'g')), '{p}'), '')" for p in P.SPLICES)


@query("r8_punctuation_rules", rf"""WITH {SPEC}, {_WIDE}, long AS (SELECT * FROM wide WHERE length(trim(text)) >= 10),
runs AS (SELECT doc_id, para_idx, regexp_extract_all(regexp_replace(text, '^\s+', ''), '  +') AS h FROM long WHERE NOT regexp_matches(text, {quoted('|'.join(f'(?:{p})' for p in P.SPACED))})),
splices AS (SELECT doc_id, para_idx, coalesce({_SPLICE}) AS h FROM long)
SELECT doc_id, para_idx::INTEGER AS para_idx, 'PUN001' AS rule_id, len(h)::INTEGER AS n, md5(h[1]) AS flagged_md5 FROM runs WHERE len(h) > 0 UNION ALL SELECT doc_id, para_idx::INTEGER, 'PUN002', 1, md5(h) FROM splices WHERE h IS NOT NULL""")
def punctuation_rules(spark: SparkSession, sf: str) -> DataFrame:
    text, i = F.col("text"), F.col("para_idx") % 5
    wide = F.when(i == 0, F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("  ")))).when(i == 1, F.replace(text, F.lit(" of "), F.lit(", it runs of "))).when(i == 2, F.replace(text, F.lit(". "), F.lit(", however "))).when(i == 3, F.concat(F.lit("4.1  "), text, F.lit("  end"))).otherwise(text)
    found = P.punctuation_rules(spec(spark, sf).withColumn("text", wide))
    return found.select("doc_id", "para_idx", "rule_id", "n", F.md5("flagged").alias("flagged_md5"))
