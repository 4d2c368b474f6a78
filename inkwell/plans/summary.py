"""Queries on summaries; the SQL makes the sentence graph of each document edge by edge and iterates it by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import summary as S
from inkwell.plans.metrics import LINES, STOP, W, cut, docs
from inkwell.registry import query

RANKS = f"""{LINES}, sents AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, j) - 1 AS sent, sentence, list_filter(list_transform(regexp_extract_all(sentence, {W}), lambda x: lower(x)), lambda x: x NOT IN ({STOP})) AS words
  FROM (SELECT doc_id, para_idx, unnest(c) AS sentence, generate_subscripts(c, 1) AS j FROM (SELECT doc_id, para_idx, {cut('space')} AS c FROM lines))
), terms AS (
  SELECT doc_id, sent, len(words) AS n, unnest(words) AS word FROM sents
), counts AS (
  SELECT doc_id, sent, n, word, count(*) AS c FROM terms GROUP BY ALL
), edges AS (
  SELECT doc_id, a.sent AS i, b.sent AS j, sum(a.c * b.c) / CASE WHEN a.n * b.n > 1 THEN ln(a.n::DOUBLE) + ln(b.n::DOUBLE) ELSE 1.0 END AS w
  FROM counts a JOIN counts b USING (doc_id, word) GROUP BY doc_id, a.sent, b.sent, a.n, b.n
), steps AS (
  SELECT doc_id, i, j, w / sum(w) OVER (PARTITION BY doc_id, i) AS share FROM edges
), sizes AS (
  SELECT doc_id, count(*) AS size FROM sents WHERE len(words) > 0 GROUP BY 1
), walk(doc_id, sent, rank, turn, moved) AS (
  SELECT doc_id, sent, 1.0::DOUBLE / size, 0, 1.0::DOUBLE FROM sents JOIN sizes USING (doc_id) WHERE len(words) > 0
  UNION ALL
  SELECT doc_id, sent, rank, turn, sqrt(sum((rank - old) ** 2) OVER (PARTITION BY doc_id)) FROM (
    SELECT p.doc_id, p.sent, p.rank AS old, p.turn + 1 AS turn, (1 - {S.DAMPING}::DOUBLE) / z.size * p.every + {S.DAMPING}::DOUBLE * coalesce(g.got, 0) AS rank
    FROM (SELECT *, sum(rank) OVER (PARTITION BY doc_id) AS every FROM walk WHERE moved > {S.CLOSE}::DOUBLE) p JOIN sizes z ON p.doc_id = z.doc_id
      LEFT JOIN (SELECT s.doc_id, s.j, sum(w.rank * s.share) AS got FROM walk w JOIN steps s ON w.doc_id = s.doc_id AND w.sent = s.i GROUP BY 1, 2) g ON g.doc_id = p.doc_id AND g.j = p.sent)
), ranked AS (
  SELECT doc_id, sent, sentence, coalesce(arg_max(rank, turn), 0) AS rank FROM sents LEFT JOIN walk USING (doc_id, sent) GROUP BY ALL
), chosen AS (
  SELECT doc_id, sent, sentence, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(rank, 9) DESC, sent) <= {S.SENTENCES}
)"""
PHRASES = "list_distinct(list_transform(list_filter(list_transform(range(1, len({w}) - 1), lambda i: {w}[i:i + 2]), lambda r: len(list_filter(r, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in S.PHRASE_STOPWORDS) + "))) > 0), lambda r: array_to_string(r, ' ')))"
OWN_WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))"


@query("g7_summaries", f"WITH RECURSIVE {RANKS} SELECT doc_id, sent::BIGINT AS sent, md5(sentence) AS sentence_md5, round(rank, 6) AS rank FROM chosen")
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    found = S.summaries(docs(spark, sf))
    return found.select("doc_id", F.col("sent").cast("long").alias("sent"), F.md5("sentence").alias("sentence_md5"), F.round("rank", 6).alias("rank"))


@query(
    "g7_summary_coverage",
    f"""WITH RECURSIVE {RANKS}, known AS (SELECT doc_id, {PHRASES.format(w='w')} AS known FROM (SELECT doc_id, {OWN_WORDS.format("string_agg(sentence, ' ' ORDER BY sent)")} AS w FROM chosen GROUP BY doc_id)),
paras AS (SELECT doc_id, para_idx, {PHRASES.format(w='w')} AS own FROM (SELECT doc_id, para_idx, {OWN_WORDS.format('text')} AS w FROM lines WHERE length(trim(text)) >= {S.SHORTEST})),
found AS (SELECT doc_id, para_idx, len(own) AS phrases, len(list_intersect(own, coalesce(known, []))) / (len(own) + 1)::DOUBLE AS coverage FROM paras LEFT JOIN known USING (doc_id)),
marked AS (SELECT *, coverage < {S.LOW} AND phrases > {S.FEW} AS low FROM found)
SELECT doc_id, para_idx::BIGINT AS para_idx, phrases::BIGINT AS phrases, round(coverage, 9) AS coverage, low, coalesce(low AND para_idx = min(para_idx) FILTER (low) OVER (PARTITION BY doc_id), false) AS reported FROM marked""",
)
def summary_coverage(spark: SparkSession, sf: str) -> DataFrame:
    found = S.summary_coverage(docs(spark, sf))
    return found.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.col("phrases").cast("long").alias("phrases"), "coverage", "low", "reported")
