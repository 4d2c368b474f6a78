"""Queries that scan documents by rules and score them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import rules as R
from inkwell.operators import text as T
from inkwell.plans.metrics import LINES, cut, docs
from inkwell.registry import query, table

#: Phrases of the words that the corpus has; packs are data, these show the scan at scale.
PHRASES = [R.Rule(f"phrase_{i}", "phrases", "phrase", p, s, c, r) for i, (p, s, c, r) in enumerate([("of the", "Low", "Wordiness", ""), ("to the", "Low", "Wordiness", ""), ("and the", "Info", "Style", ""), ("all rights reserved", "Info", "Legal", ""), ("licensed under the", "Info", "Legal", ""), ("de la", "Low", "Wordiness", ""), ("idiot", "High", "Tone", "person"), ("stupid", "High", "Tone", "unwise"), ("trash", "Medium", "Tone", "waste")])]
REGEXES = [
    R.Rule("capitals", "style", "regex", r"[A-Z]{4,}", "Low", "Style"),
    R.Rule("doubled_mark", "grammar", "regex", r"[!?]{2,}", "Medium", "Grammar"),
    R.Rule("number", "units", "regex", r"[0-9]+", "Info", "Units"),
    R.Rule("symbols", "style", "regex", r"[%&$#*]{3,}", "High", "Junk"),
    R.Rule("address", "privacy", "regex", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "Critical", "Privacy"),
]
REPEATED = r"""rw AS (SELECT doc_id, para_idx, p AS pos, w[p] AS word, w[p + 2] AS second FROM (
    SELECT doc_id, para_idx, w, unnest(range(1, len(w) - 1)) AS p FROM (SELECT doc_id, para_idx, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+') AS w FROM {0}))
  WHERE regexp_matches(w[p], '^[\p{L}\p{N}\p{M}_]+$') AND regexp_matches(w[p + 1], '^\s+$') AND lower(w[p]) = lower(w[p + 2])),
hits AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY pos) * 2 AS run FROM rw),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx, run ORDER BY pos) AS k FROM hits),
repeated AS (SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY pos) - 1 AS hit_idx, word, second, pos FROM firsts WHERE k % 2 = 1)"""
CLEAN = f"clean AS (SELECT * FROM lines WHERE length(trim(text)) >= 5 AND NOT regexp_matches(text, '{T.BOILERPLATE_PATTERN}'))"
ALLOWED = "('that', 'had', 'very', 'really')"


@query("r4_repeated_words", f"WITH {LINES}, {REPEATED.replace('{0}', 'lines')} SELECT doc_id, count(*) AS hits, count(DISTINCT para_idx) AS paragraphs, count(DISTINCT lower(word)) AS words FROM repeated WHERE lower(word) NOT IN {ALLOWED} GROUP BY doc_id")
def repeated_words(spark: SparkSession, sf: str) -> DataFrame:
    hits = T.repeated_words(T.paragraphs(docs(spark, sf)))
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.countDistinct("para_idx").alias("paragraphs"), F.countDistinct(F.lower(F.regexp_extract("hit", r"(?U)^(\w+)", 1))).alias("words"))


@query("r5_long_sentences", f"WITH {LINES} SELECT doc_id, para_idx::INTEGER AS para_idx, len(string_split(s, ' '))::INTEGER AS words, md5(s) AS sentence_md5 FROM (SELECT doc_id, para_idx, unnest({cut('space')}) AS s FROM lines) WHERE len(string_split(s, ' ')) > 40")
def long_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return R.long_sentences(T.paragraphs(docs(spark, sf)), 40).select("doc_id", "para_idx", "words", F.md5("sentence").alias("sentence_md5"))


_VALUES = ", ".join(f"('{r.rule_id}', '{r.pattern}', '{r.severity}', '{r.category}')" for r in PHRASES)


@query("r1_phrase_scan", rf"""WITH {LINES}, rules(rule_id, pattern, severity, category) AS (VALUES {_VALUES}),
w AS (SELECT doc_id, para_idx, list_transform(regexp_extract_all(text, '[a-zA-Z]+(?:''[a-zA-Z]+)?'), lambda x: lower(x)) AS w FROM lines),
g AS (SELECT doc_id, para_idx, unnest(w) AS gram FROM w UNION ALL SELECT doc_id, para_idx, array_to_string(w[i : i + 1], ' ') FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT doc_id, para_idx, array_to_string(w[i : i + 2], ' ') FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w))
SELECT doc_id, rule_id, severity, category, count(*) AS hits FROM g JOIN rules ON gram = pattern GROUP BY ALL""")
def phrase_scan(spark: SparkSession, sf: str) -> DataFrame:
    hits = R.phrase_scan(T.paragraphs(docs(spark, sf)), R.rules_table(spark, PHRASES))
    return hits.groupBy("doc_id", "rule_id", "severity", "category").agg(F.count("*").alias("hits"))


_SCANS = " UNION ALL ".join(f"SELECT doc_id, para_idx, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category, unnest(regexp_extract_all(text, '{r.pattern}')) AS hit FROM lines" for r in REGEXES)


@query("r2_regex_scan", f"WITH {LINES} SELECT doc_id, rule_id, severity, category, count(*) AS hits, count(DISTINCT hit) AS texts FROM ({_SCANS}) GROUP BY ALL")
def regex_scan(spark: SparkSession, sf: str) -> DataFrame:
    return R.regex_scan(T.paragraphs(docs(spark, sf)), REGEXES).groupBy("doc_id", "rule_id", "severity", "category").agg(F.count("*").alias("hits"), F.countDistinct("hit").alias("texts"))


@query("r3_scan_with_exemptions", f"WITH {LINES}, e AS (SELECT DISTINCT doc_id, para_idx FROM lines WHERE regexp_matches(text, '(?i)licen[cs]ed? |rights reserved')) SELECT rule_id, count(*) AS hits FROM ({_SCANS}) s ANTI JOIN e USING (doc_id, para_idx) GROUP BY rule_id")
def scan_with_exemptions(spark: SparkSession, sf: str) -> DataFrame:
    paras = T.paragraphs(docs(spark, sf))
    return R.without_context(R.regex_scan(paras, REGEXES), paras, "(?i)licen[cs]ed? |rights reserved").groupBy("rule_id").agg(F.count("*").alias("hits"))


REVIEW = rf"""{LINES}, {CLEAN}, {REPEATED.replace("{0}", "clean")},
s AS (SELECT doc_id, para_idx, generate_subscripts(c, 1) AS i, unnest(c) AS s FROM (SELECT doc_id, para_idx, {cut("space")} AS c FROM clean)),
issues AS (
  SELECT doc_id, para_idx, pos AS spot, 'grammar' AS category, 2.0::DOUBLE AS weight, lower(word) AS flagged, word || second AS exact FROM repeated WHERE lower(word) NOT IN {ALLOWED}
  UNION ALL SELECT doc_id, para_idx, 1000000 + i, 'sentence length', 0.5, s, s FROM s WHERE len(string_split(s, ' ')) > 40
  UNION ALL SELECT doc_id, para_idx, 2000000 + i, 'clarity', 0.1, s, s FROM s WHERE lower(string_split(s, ' ')[1]) IN ('and', 'but', 'or', 'so', 'for', 'nor', 'yet', 'because', 'also')),
once AS (SELECT * FROM issues QUALIFY row_number() OVER (PARTITION BY doc_id, para_idx, category, CASE WHEN category = 'grammar' THEN exact ELSE substr(flagged, 1, 80) END ORDER BY spot) = 1)"""


@query("review_scores", rf"""WITH {REVIEW},
t AS (SELECT doc_id, weight * CASE WHEN i = 1 THEN 1.0 ELSE 1 / ln(i + 1) END AS takes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY para_idx, spot) AS i FROM once)),
per AS (SELECT doc_id, count(*) AS n, round(sum(takes), 9) AS takes FROM t GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS issues, floor(100 - least(80.0, coalesce(CASE WHEN n > 20 THEN takes / log10(n + 1) ELSE takes END, 0) / 2))::INTEGER AS score FROM documents LEFT JOIN per USING (doc_id))
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM scored""")
def review_scores(spark: SparkSession, sf: str) -> DataFrame:
    return R.review(docs(spark, sf))


@query("w4_dedupe_issues", f"WITH {REVIEW} SELECT doc_id, category, count(*) AS issues FROM once GROUP BY ALL")
def dedupe_issues(spark: SparkSession, sf: str) -> DataFrame:
    once = R.dedupe_issues(R.review_issues(docs(spark, sf)))
    return once.groupBy("doc_id", F.lower("category").alias("category")).agg(F.count("*").alias("issues"))


@query("a31_issue_summary", f"WITH {REVIEW} SELECT doc_id, CASE category WHEN 'grammar' THEN 'Medium' WHEN 'clarity' THEN 'Info' WHEN 'sentence length' THEN 'Low' END AS severity, category, count(*) AS issues, count(DISTINCT para_idx) AS paragraphs FROM once GROUP BY ROLLUP (doc_id, severity, category)")
def issue_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.issue_summary(R.dedupe_issues(R.review_issues(docs(spark, sf))))


@query("u4_exact_duplicates", "SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("s1_read_corpus", "SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def read_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
