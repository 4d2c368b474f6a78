"""Queries on texts: their parts, counts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import metrics as M
from inkwell.operators import text as T
from inkwell.registry import query, spread, table

W = r"'[a-zA-Z]+(?:''[a-zA-Z]+)?'"
LINES = "lines AS (SELECT doc_id, i - 1 AS para_idx, p AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(p) <> '')"
TOKENS = f"tokens AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM (SELECT doc_id, list_transform(regexp_extract_all(text, {W}), lambda x: lower(x)) AS w FROM documents))"
COUNTED = "counted AS (SELECT doc_id, word, count(*) AS n FROM tokens GROUP BY ALL)"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
SPLIT = {
    "space": r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))",
    "capital": r"string_split(regexp_replace({}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))",
    "marks": r"string_split_regex({}, '[.!?]+')",
}


def cut(mode: str, of: str = "text") -> str:
    return rf"list_filter(list_transform({SPLIT[mode].format(of)}, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("t1_paragraphs", f"WITH {LINES} SELECT doc_id, para_idx::BIGINT AS para_idx, md5(text) AS text_md5, length(text) AS chars FROM lines")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return T.paragraphs(docs(spark, sf)).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


@query("t2_boilerplate", f"WITH {LINES} SELECT doc_id, count(*) AS kept, sum(length(text))::BIGINT AS chars FROM lines WHERE length(trim(text)) >= 5 AND NOT regexp_matches(text, '{T.BOILERPLATE_PATTERN.replace(chr(39), chr(39) * 2)}') GROUP BY doc_id")
def boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return T.drop_boilerplate(T.paragraphs(docs(spark, sf))).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("text").cast("long")).alias("chars"))


def _sentences(mode: str) -> None:
    sql = f"SELECT doc_id, count(*) AS sentences, sum(length(s))::BIGINT AS chars, max(md5(s)) AS last_md5 FROM (SELECT doc_id, unnest({cut(mode)}) AS s FROM documents) GROUP BY doc_id"

    @query(f"t3_sentences_{mode}", sql)
    def found(spark: SparkSession, sf: str) -> DataFrame:
        return T.sentences(docs(spark, sf), mode).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence").cast("long")).alias("chars"), F.max(F.md5("sentence")).alias("last_md5"))


for _mode in SPLIT:
    _sentences(_mode)


@query("t4_tokens", f"WITH {TOKENS} SELECT doc_id, pos::BIGINT AS pos, word FROM tokens")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return T.tokens(docs(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query("t5_stopword_filter", f"WITH {TOKENS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS documents FROM tokens WHERE length(word) >= 3 AND word NOT IN ({STOP}) GROUP BY word")
def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = T.without_stopwords(M.word_counts(docs(spark, sf)))
    return kept.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


@query("t6_ngrams", f"WITH {TOKENS}, g AS (SELECT doc_id, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) >= 5")
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return T.ngrams(docs(spark, sf), 3).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 5")


SYLLABLES = """greatest(1, len(regexp_extract_all(b, '[aeiouy]+'))
  - CASE WHEN b LIKE '%e' AND len(regexp_extract_all(b, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(b, '[^aeiouy]le$') THEN 1 ELSE 0 END)"""
KNOWN = "CASE word " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"simile": 3, "forever": 3, "shoreline": 2, "define": 2, "everything": 4, "another": 3, "higher": 2, "business": 3, "area": 3, "idea": 3, "real": 1, "create": 2, "science": 2}.items()) + f" ELSE {SYLLABLES} END"
BASE = rf"""{TOKENS}, y AS (SELECT doc_id, word, {KNOWN} AS y FROM (SELECT doc_id, word, regexp_replace(word, '[^a-z]', '', 'g') AS b FROM tokens)),
per AS (SELECT doc_id, count(*) AS words, sum(y)::BIGINT AS syllables, count(*) FILTER (y >= 3) AS complex_words, sum(length(word))::BIGINT AS letters FROM y GROUP BY doc_id),
base AS (SELECT d.doc_id, length(text)::BIGINT AS chars, length(regexp_replace(text, '[ \n\t]', '', 'g'))::BIGINT AS chars_no_space, coalesce(words, 0) AS words,
  len({cut("capital")})::BIGINT AS sentences, len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''))::BIGINT AS paragraphs,
  coalesce(syllables, 0) AS syllables, coalesce(complex_words, 0) AS complex_words, coalesce(letters, 0) AS letters
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d LEFT JOIN per USING (doc_id))"""
SHARE = "CASE WHEN {1} = 0 THEN 0.0 ELSE {0} / {1}::DOUBLE END"


@query("a1_basic_statistics", f"WITH {BASE} SELECT doc_id, chars, chars_no_space, words, sentences, paragraphs, syllables, {SHARE.format('chars_no_space', 'words')} AS word_length, {SHARE.format('words', 'sentences')} AS sentence_length, {SHARE.format('syllables', 'words')} AS word_syllables, {SHARE.format('words', 'paragraphs')} AS paragraph_length, words / 200.0::DOUBLE AS reading_minutes, words / 150.0::DOUBLE AS speaking_minutes FROM base")
def basic_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return M.basic_statistics(docs(spark, sf))


READABILITY = f"""{BASE}, r AS (SELECT *, words / sentences::DOUBLE AS wps, syllables / words::DOUBLE AS spw, complex_words / words::DOUBLE AS hard, letters / words::DOUBLE AS cpw FROM base WHERE words > 0 AND sentences > 0),
scores AS (SELECT doc_id, 206.835::DOUBLE - 1.015::DOUBLE * wps - 84.6::DOUBLE * spw AS flesch_ease, 0.39::DOUBLE * wps + 11.8::DOUBLE * spw - 15.59::DOUBLE AS kincaid_grade, 0.4::DOUBLE * (wps + 100 * hard) AS fog,
  CASE WHEN sentences >= 30 THEN 1.043::DOUBLE * sqrt(complex_words * (30 / sentences::DOUBLE)) + 3.1291::DOUBLE END AS smog, 4.71::DOUBLE * cpw + 0.5::DOUBLE * wps - 21.43::DOUBLE AS ari,
  0.0588::DOUBLE * cpw * 100 - 0.296::DOUBLE * (sentences / words::DOUBLE) * 100 - 15.8::DOUBLE AS coleman_liau, hard * 100 AS complex_pct FROM r)"""


@query("a2_readability", f"WITH {READABILITY} SELECT * FROM scores")
def readability(spark: SparkSession, sf: str) -> DataFrame:
    return M.readability(docs(spark, sf))


@query("a2_readability_clamped", f"WITH {READABILITY} SELECT doc_id, greatest(0, least(100, flesch_ease)) AS flesch_ease, greatest(0, kincaid_grade) AS kincaid_grade FROM scores")
def readability_clamped(spark: SparkSession, sf: str) -> DataFrame:
    return M.readability(docs(spark, sf), clamp=True).select("doc_id", "flesch_ease", "kincaid_grade")


@query("a4_readability_labels", f"WITH {READABILITY} SELECT ease_label, grade_label, count(*) AS documents FROM (SELECT CASE WHEN flesch_ease >= 90 THEN 'Very Easy' WHEN flesch_ease >= 80 THEN 'Easy' WHEN flesch_ease >= 70 THEN 'Fairly Easy' WHEN flesch_ease >= 60 THEN 'Standard' WHEN flesch_ease >= 50 THEN 'Fairly Difficult' WHEN flesch_ease >= 30 THEN 'Difficult' ELSE 'Very Difficult' END AS ease_label, CASE WHEN kincaid_grade <= 6 THEN 'Elementary school' WHEN kincaid_grade <= 8 THEN 'Middle school' WHEN kincaid_grade <= 12 THEN 'High school' WHEN kincaid_grade <= 16 THEN 'College' ELSE 'Graduate level' END AS grade_label FROM scores) GROUP BY ALL")
def readability_labels(spark: SparkSession, sf: str) -> DataFrame:
    return M.readability_labels(M.readability(docs(spark, sf))).groupBy("ease_label", "grade_label").agg(F.count("*").alias("documents"))


@query("a5_complexity", f"""WITH s AS (SELECT doc_id, x, len(regexp_extract_all(x, {W})) AS n FROM (SELECT doc_id, unnest({cut("capital")}) AS x FROM documents)),
per AS (SELECT doc_id, avg(n) AS mean, min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest, stddev_pop(n) AS spread, count(*) FILTER (n >= 30) AS long_sentences, count(*) FILTER (regexp_matches(lower(x), '{"|".join(M.CLAUSE_MARKERS)}')) AS clause_sentences FROM s GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(text, {W}) AS w FROM documents)
SELECT doc_id, mean, round(spread, 9) AS spread, shortest, longest, long_sentences, len(list_filter(w, lambda x: length(x) >= 7))::BIGINT AS long_words, clause_sentences FROM per JOIN w USING (doc_id) WHERE len(w) > 0""")
def complexity(spark: SparkSession, sf: str) -> DataFrame:
    return M.complexity(docs(spark, sf)).withColumn("spread", F.round("spread", 9))


@query("a6_length_distribution", f"WITH {TOKENS} SELECT length(word)::INTEGER AS length, count(*) AS words FROM tokens GROUP BY 1")
def length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return M.length_distribution(docs(spark, sf))


@query("a7_vocabulary", f"WITH {TOKENS}, {COUNTED}, per AS (SELECT doc_id, sum(n)::BIGINT AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS once, count(*) FILTER (n = 2) AS twice, sum(n * n)::BIGINT AS squares FROM counted GROUP BY doc_id) SELECT doc_id, tokens, types, once, twice, types / tokens::DOUBLE AS type_token_ratio, once / types::DOUBLE AS once_ratio, tokens / types::DOUBLE AS mean_frequency, 10000.0::DOUBLE * (squares - tokens) / (tokens * tokens) AS yules_k FROM per")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return M.vocabulary(docs(spark, sf))


@query("a8_yules_k_by_spectrum", f"WITH {TOKENS}, {COUNTED}, s AS (SELECT doc_id, n, count(*) AS of FROM counted GROUP BY ALL), per AS (SELECT doc_id, sum(n * of)::BIGINT AS tokens, sum(n * of * of)::BIGINT AS m2 FROM s GROUP BY doc_id) SELECT doc_id, CASE WHEN m2 = tokens THEN 0.0 ELSE 10000.0::DOUBLE * (m2 - tokens) / (tokens * tokens) END AS yules_k FROM per")
def yules_k(spark: SparkSession, sf: str) -> DataFrame:
    return M.yules_k_by_spectrum(docs(spark, sf))


@query("a9_sttr", f"WITH {TOKENS}, b AS (SELECT doc_id, pos // 100 AS b, count(*) AS n, count(DISTINCT word) / 100.0::DOUBLE AS r FROM tokens GROUP BY ALL) SELECT d.doc_id, round(avg(r), 9) AS sttr FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND n = 100 GROUP BY d.doc_id")
def sttr(spark: SparkSession, sf: str) -> DataFrame:
    return M.sttr(docs(spark, sf)).withColumn("sttr", F.round("sttr", 9))


@query("a10_windowed_ttr", f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, {W}), lambda x: lower(x)) AS w FROM documents), z AS (SELECT *, least(100, len(w)) AS size FROM w WHERE len(w) > 0),
r AS (SELECT doc_id, list_transform(range(0, len(w) - size + 1, greatest(1, size // 2)), lambda i: len(list_distinct(w[i + 1 : i + size])) / size::DOUBLE) AS r FROM z)
SELECT doc_id, len(r)::BIGINT AS windows, list_min(r) AS lowest, len(list_filter(r, lambda x: x < 0.2))::BIGINT AS low_windows FROM r""")
def windowed_ttr(spark: SparkSession, sf: str) -> DataFrame:
    return M.windowed_ttr(docs(spark, sf))


@query("a12_word_overuse", f"WITH {TOKENS}, {COUNTED}, t AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS share FROM counted) SELECT doc_id, word, n, share FROM t WHERE word NOT IN ({STOP}) AND length(word) > 4 AND n >= 10 AND share > 0.03 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) <= 20")
def word_overuse(spark: SparkSession, sf: str) -> DataFrame:
    return M.word_overuse(docs(spark, sf))


@query("a13_sentence_types", f"WITH s AS (SELECT doc_id, unnest({cut('capital')}) AS s FROM documents), p AS (SELECT doc_id, lower(string_split(s, ' ')[1]) AS first, count(*) AS n, count(*) FILTER (s LIKE '%?') AS asks, count(*) FILTER (s LIKE '%!') AS cries FROM s GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS sentences, sum(asks)::BIGINT AS interrogative, sum(cries)::BIGINT AS exclamatory, count(*) / sum(n)::DOUBLE AS starter_diversity, count(*) FILTER (n >= 3) AS repeated_starters FROM p GROUP BY doc_id")
def sentence_types(spark: SparkSession, sf: str) -> DataFrame:
    return M.sentence_types(docs(spark, sf))


@query("a14_sentence_variety", f"WITH s AS (SELECT doc_id, unnest({cut('marks')}) AS s FROM documents), p AS (SELECT doc_id, count(*) AS n, var_pop(len(string_split(s, ' '))) AS v, count(DISTINCT lower(string_split(s, ' ')[1])) / count(*)::DOUBLE * 100 AS u FROM s GROUP BY doc_id) SELECT doc_id, round(CASE WHEN coalesce(n, 0) < 2 THEN 50.0 ELSE (least(50.0, v) + u) / 2 END, 8) AS variety FROM documents LEFT JOIN p USING (doc_id)")
def sentence_variety(spark: SparkSession, sf: str) -> DataFrame:
    return M.sentence_variety(docs(spark, sf)).withColumn("variety", F.round("variety", 8))


@query("a15_technical_complexity", r"WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS n, len(regexp_extract_all(text, '\b[A-Z]{2,5}\b')) AS a, len(regexp_extract_all(text, '\b\d+\.?\d*\b')) AS d, len(regexp_extract_all(text, '(?i)\b(?:mm|cm|m|km|kg|lb|Hz|MHz|GHz|V|A|W|dB)\b')) AS u FROM (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g') AS text FROM documents)) SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE least(100.0, a / n::DOUBLE * 100 * 5 + d / n::DOUBLE * 100 * 3 + u / n::DOUBLE * 100 * 10) END AS technical_complexity FROM c")
def technical_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return M.technical_complexity(docs(spark, sf))


_N = "len(regexp_extract_all(text, '{}'))::BIGINT"


@query("a16_technical_metrics", "SELECT doc_id, " + _N.format(r"(?i)\b(?:is|are|was|were|been|being|be)\s+\w+ed\b") + " + " + _N.format(r"(?i)\b(?:is|are|was|were|been|being|be)\s+\w+en\b") + " AS passives, " + ", ".join(_N.format(rf"(?i)\b{w}\b") + f" AS {w}" for w in ("shall", "will", "must", "should", "may", "can")) + ", " + _N.format(r"\b[A-Z]{2,}\b") + " AS acronyms, " + _N.format(r"\b\d+(?:\.\d+)?\b") + " AS numbers, " + _N.format(r"(?m)^\s*[•●○◦▪▫-]\s") + " AS bullets, " + _N.format(r"(?m)^\s*\d+[.)]\s") + f" AS numbered, len(list_filter(regexp_extract_all(raw, {W}), lambda w: length(w) > 10))::BIGINT AS jargon FROM (SELECT doc_id, text AS raw, regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g') AS text FROM documents)")
def technical_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.technical_metrics(docs(spark, sf))


@query("a22_keyword_frequency", f"WITH {TOKENS}, {COUNTED}, t AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id)::DOUBLE * 100 AS density FROM counted) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word)::INTEGER AS place, word, n, density FROM t WHERE length(word) >= 3 AND word NOT IN ({STOP}) QUALIFY place <= 10")
def keyword_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return M.keyword_frequency(docs(spark, sf))


@query("a23_tfidf_keywords", f"WITH {TOKENS}, {COUNTED}, k AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY word) AS df FROM counted WHERE length(word) >= 3 AND word NOT IN ({STOP})), s AS (SELECT doc_id, word, n / total::DOUBLE * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS score FROM k) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, word)::INTEGER AS place, word, round(score, 9) AS score FROM s QUALIFY place <= 5")
def tfidf_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return M.tfidf_keywords(docs(spark, sf)).withColumn("score", F.round("score", 9))


def _gram(n: int) -> str:
    later = " || ".join(["word", *[f"' ' || lead(word, {i}) OVER o" for i in range(1, n)]])
    return f"SELECT doc_id, gram, count(*) AS n, {n} AS size FROM (SELECT doc_id, {later} AS gram FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE gram IS NOT NULL GROUP BY ALL HAVING count(*) >= 3"


@query("a24_repeated_phrases", f"WITH {TOKENS}, g AS ({_gram(3)} UNION ALL {_gram(4)} UNION ALL {_gram(5)}) SELECT doc_id, gram, n, size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size DESC, gram)::INTEGER AS place FROM g QUALIFY place <= 20")
def repeated_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return M.repeated_phrases(docs(spark, sf))


@query("a24_repeated_lines", f"WITH {LINES}, l AS (SELECT trim(text) AS line, doc_id, count(*) AS n FROM lines GROUP BY ALL) SELECT line, count(*) AS documents, sum(n)::BIGINT AS times FROM l GROUP BY line HAVING count(*) >= 3")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return M.repeated_lines(docs(spark, sf))
