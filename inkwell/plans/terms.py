"""Queries on terms and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import terms as C
from inkwell.plans.metrics import BASE, COUNTED, LINES, STOP, TOKENS, W, cut, docs
from inkwell.plans.similar import BENCH, dictionary
from inkwell.registry import query, table

GROUPS = [("are", "are"), ("are", "is"), ("of", "of"), ("of", "de"), ("and", "and"), ("and", "und"), ("and", "et")]
TOK = f"{TOKENS}, {COUNTED}"


@query("a17_case_variants", f"WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, {W})) AS form FROM documents), p AS (SELECT doc_id, lower(form) AS term, CASE WHEN form = upper(form[1]) || lower(form[2:]) THEN lower(form) ELSE form END AS form, count(*) AS n FROM f WHERE length(form) >= 2 AND form NOT LIKE '%''%' GROUP BY ALL) SELECT doc_id, term, count(*) AS forms, sum(n)::BIGINT AS n, arg_max(form, (n, form)) AS dominant FROM p GROUP BY doc_id, term HAVING count(*) >= 2")
def case_variants(spark: SparkSession, sf: str) -> DataFrame:
    return C.case_variants(docs(spark, sf), shortest=2).where(~F.contains("term", F.lit("'")))


@query("a17_term_variant_mix", f"WITH {TOK}, g(grp, word) AS (VALUES {', '.join(f'{x!r}' for x in GROUPS)}), p AS (SELECT doc_id, grp, word, n FROM counted JOIN g USING (word)) SELECT doc_id, grp AS \"group\", count(*) AS forms, sum(n)::BIGINT AS n, arg_max(word, (n, word)) AS dominant FROM p GROUP BY doc_id, grp HAVING count(*) >= 2")
def term_variant_mix(spark: SparkSession, sf: str) -> DataFrame:
    return C.term_variant_mix(docs(spark, sf), spark.createDataFrame(GROUPS, "group string, form string"))


@query("a19_format_consistency", r"SELECT doc_id, ((CASE WHEN regexp_matches(text, '\b\d{4}-\d{2}-\d{2}\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '\b\d{1,2}/\d{1,2}/\d{2,4}\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '\b\d{1,2}\.\d{1,2}\.\d{2,4}\b') THEN 1 ELSE 0 END))::INTEGER AS date_formats, len(regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})+'))::INTEGER AS with_comma, len(list_filter(regexp_extract_all(text, '[0-9,]+'), lambda x: regexp_matches(x, '^[0-9]{4,}$')))::INTEGER AS without_comma FROM documents")
def format_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return C.format_consistency(docs(spark, sf))


@query("a25_keyword_clustering", f"WITH {LINES}, z AS (SELECT doc_id, max(para_idx) + 1 AS size FROM lines GROUP BY 1), w AS (SELECT DISTINCT doc_id, para_idx, lower(unnest(regexp_extract_all(text, {W}))) AS word FROM lines), p AS (SELECT doc_id, word, count(*) AS paragraphs, count(*) FILTER (floor(para_idx * 4 / size::DOUBLE) = 0) AS f, count(*) FILTER (floor(para_idx * 4 / size::DOUBLE) = 3) AS l FROM w JOIN z USING (doc_id) WHERE length(word) > 4 AND word NOT IN ({STOP}) GROUP BY ALL) SELECT doc_id, word, paragraphs, CASE WHEN f / paragraphs::DOUBLE > 0.6 THEN 'first' ELSE 'last' END AS place FROM p WHERE paragraphs >= 3 AND (f / paragraphs::DOUBLE > 0.6 OR l / paragraphs::DOUBLE > 0.6)")
def keyword_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return C.keyword_clustering(docs(spark, sf), least=3, over=0.6)


@query("a26_domain_coverage", f"WITH {BENCH}, {TOK}, f AS (SELECT doc_id, count(*) AS found FROM counted JOIN dict USING (word) GROUP BY 1), s AS (SELECT doc_id, coalesce(found, 0) AS found, coalesce(found, 0) / (SELECT count(*) FROM dict)::DOUBLE AS coverage FROM documents LEFT JOIN f USING (doc_id)) SELECT *, coverage < 0.15 AS low FROM s")
def domain_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return C.domain_coverage(docs(spark, sf), dictionary(spark, sf))


@query("a27_technical_hapax", f"WITH {TOK} SELECT doc_id, count(*) AS words FROM counted WHERE n = 1 AND length(word) > 7 AND regexp_matches(word, '{C.TECHNICAL_SUFFIX}') GROUP BY 1")
def technical_hapax(spark: SparkSession, sf: str) -> DataFrame:
    return C.technical_hapax(docs(spark, sf))


VOCABULARY = f"v AS (SELECT doc_id, sum(c.n)::BIGINT AS words, sum(CASE WHEN d.word IS NOT NULL THEN c.n ELSE 0 END)::BIGINT AS approved FROM counted c LEFT JOIN dict d USING (word) GROUP BY 1)"


@query("a35_controlled_vocabulary", f"WITH {BENCH}, {TOK}, {VOCABULARY} SELECT *, approved / words::DOUBLE * 100 AS approved_pct FROM v")
def controlled_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return C.controlled_vocabulary(docs(spark, sf), dictionary(spark, sf))


@query("a35_word_alternatives", f"WITH {BENCH}, {TOK}, told AS (SELECT word, length(word) % 3 = 0 AS bad FROM dict), other AS (SELECT word[1] AS letter, min(word) AS alternative FROM told WHERE NOT bad GROUP BY 1), listed AS (SELECT word, alternative FROM told LEFT JOIN other ON word[1] = letter WHERE bad) SELECT doc_id, word, coalesce(alternative, '') AS alternative, count(*) AS n, min(pos)::BIGINT AS first FROM tokens JOIN listed USING (word) GROUP BY ALL")
def word_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    told = dictionary(spark, sf).select("word", (F.length("word") % 3 == 0).alias("bad"), F.substring("word", 1, 1).alias("letter"))
    other = told.where("NOT bad").groupBy("letter").agg(F.min("word").alias("alternative"))
    found = C.word_alternatives(docs(spark, sf), told.where("bad").join(other, "letter", "left").select("word", "alternative"))
    return found.withColumn("first", F.col("first").cast("long"))


@query("a3_easy_word_grades", f"WITH {BENCH}, {BASE}, {COUNTED}, {VOCABULARY}, h AS (SELECT doc_id, b.words / b.sentences::DOUBLE AS wps, (v.words - v.approved) / v.words::DOUBLE * 100 AS pct FROM base b JOIN v USING (doc_id) WHERE b.words > 0 AND b.sentences > 0) SELECT doc_id, 0.141::DOUBLE * wps + 0.086::DOUBLE * pct + 0.839::DOUBLE AS spache, 0.1579::DOUBLE * pct + 0.0496::DOUBLE * wps + CASE WHEN pct > 5 THEN 3.6365::DOUBLE ELSE 0 END AS dale_chall FROM h")
def easy_word_grades(spark: SparkSession, sf: str) -> DataFrame:
    return C.easy_word_grades(docs(spark, sf), dictionary(spark, sf))


_LIST = "[" + STOP + "]"


@query("w10_coherence", rf"""WITH {LINES}, s AS (SELECT doc_id, para_idx, generate_subscripts(c, 1) AS i, unnest(c) AS s FROM (SELECT doc_id, para_idx, {cut("space")} AS c FROM lines)),
w AS (SELECT *, list_filter(list_distinct(list_transform(regexp_extract_all(s, {W}), lambda x: lower(x))), lambda x: NOT list_contains({_LIST}, x)) AS w FROM s),
b AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, para_idx) AS n, lag(w) OVER o IS NOT NULL AND len(list_intersect(w, lag(w) OVER o)) = 0 AND lower(regexp_extract(s, '^([A-Za-z]+)', 1)) NOT IN ({", ".join(f"'{t}'" for t in C.TRANSITIONS)}) AS b FROM w WINDOW o AS (PARTITION BY doc_id, para_idx ORDER BY i))
SELECT doc_id, count(*) FILTER (b) AS breaks, count(*) AS sentences FROM b WHERE n >= 3 GROUP BY 1""")
def coherence(spark: SparkSession, sf: str) -> DataFrame:
    return C.coherence(docs(spark, sf))


@query("t21_acronym_uses", r"WITH u AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g'), '\b[A-Z][A-Z0-9]{1,11}\b')) AS acronym FROM documents) SELECT acronym, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM u GROUP BY 1")
def acronym_uses(spark: SparkSession, sf: str) -> DataFrame:
    return C.extract_acronyms(docs(spark, sf))[1].groupBy("acronym").agg(F.count("*").alias("uses"), F.countDistinct("doc_id").alias("documents"))


@query("s8_sync_dictionary", "WITH m AS (SELECT s_name AS term, 'm' AS note FROM supplier WHERE s_suppkey % 2 = 0), l AS (SELECT s_name AS term, 'l' AS note FROM supplier WHERE s_suppkey % 3 = 0) SELECT coalesce(l.term, m.term) AS term, coalesce(l.note, m.note) AS note FROM l FULL JOIN m ON l.term = m.term")
def sync_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    side = lambda by, note: s.where(F.col("s_suppkey") % by == 0).select(F.col("s_name").alias("term"), F.lit(note).alias("note"))
    return C.sync_dictionary(side(2, "m"), side(3, "l"))


@query("k1_top_k_per_group", f"WITH {TOK} SELECT doc_id, word, n, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word))::INTEGER AS place FROM counted QUALIFY place <= 3")
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_terms(docs(spark, sf), 3)
