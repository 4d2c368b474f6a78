"""Queries on the structure and conventions of documents; most read the specification made in `statements`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import structure as S
from inkwell.operators import text as T
from inkwell.operators.statements import NUMBERED
from inkwell.plans.metrics import LINES, docs
from inkwell.plans.statements import SPEC, quoted, spec
from inkwell.registry import query, table

#: Numbered lists of the specification: some items are numbered amiss, some lists have another delimiter or a long line between.
ITEMS = r"""lists AS (SELECT doc_id, para_idx // 8 * 2 AS para_idx, CASE WHEN para_idx // 8 % 7 = 3 THEN 9 WHEN para_idx // 8 % 11 = 5 THEN para_idx // 8 % 4 ELSE para_idx // 8 % 4 + 1 END || CASE WHEN para_idx % 5 = 0 THEN '. ' ELSE ') ' END || text AS text FROM spec WHERE para_idx % 8 = 3
  UNION ALL SELECT doc_id, para_idx // 8 * 2 + 1, text FROM spec WHERE para_idx % 8 = 7)"""


def lists(spark: SparkSession, sf: str) -> DataFrame:
    s, block = spec(spark, sf), F.floor(F.col("para_idx") / 8)
    number = F.when(block % 7 == 3, 9).when(block % 11 == 5, block % 4).otherwise(block % 4 + 1)
    items = s.where("para_idx % 8 = 3").select("doc_id", (block * 2).alias("para_idx"), F.concat(number.cast("string"), F.when(F.col("para_idx") % 5 == 0, ". ").otherwise(") "), "text").alias("text"))
    return items.unionByName(s.where("para_idx % 8 = 7").select("doc_id", (block * 2 + 1).alias("para_idx"), "text"))


@query("w7_list_sequence", rf"""WITH {SPEC}, {ITEMS}, a AS (SELECT *, regexp_matches(text, '{S.LIST_ITEM}') AS is_item FROM lists),
b AS (SELECT *, count(*) FILTER (NOT is_item AND length(trim(text)) > 100) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS long FROM a),
c AS (SELECT doc_id, para_idx, long, regexp_extract(text, '{S.LIST_ITEM}', 1)::INTEGER AS number, regexp_extract(text, '{S.LIST_ITEM}', 2) AS mark FROM b WHERE is_item),
d AS (SELECT *, lag(number) OVER o AS before, lag(para_idx) OVER o IS NULL OR para_idx > lag(para_idx) OVER o + 2 OR mark <> lag(mark) OVER o OR long > lag(long) OVER o AS new FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY para_idx)),
e AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS list FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, list ORDER BY para_idx) AS place FROM e)
SELECT doc_id, para_idx, number, issue FROM (SELECT *, CASE WHEN new THEN CASE WHEN number <> 1 THEN 'start' END WHEN number = before THEN 'duplicate' WHEN number < place THEN CASE WHEN number <> 1 THEN 'order' END WHEN number > place + 1 THEN 'gap' END AS issue FROM f) WHERE issue IS NOT NULL""")
def list_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return S.list_sequence_issues(lists(spark, sf))


HEADINGS = rf"heads AS (SELECT doc_id, para_idx, regexp_extract(text, '{NUMBERED}', 1) AS number, len(string_split(regexp_extract(text, '{NUMBERED}', 1), '.')) - CASE WHEN para_idx % 5 = 0 THEN 1 ELSE 0 END AS level, substr(trim(regexp_extract(text, '{NUMBERED}', 2)), 1, 10) AS title FROM spec WHERE regexp_matches(text, '{NUMBERED}'))"


def headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings with titles cut to ten characters and some levels wrong, so that there are duplicates and mixed styles."""
    number = F.regexp_extract("text", NUMBERED, 1)
    level = F.size(F.split(number, r"\.")) - F.when(F.col("para_idx") % 5 == 0, 1).otherwise(0)
    return spec(spark, sf).where(F.regexp_like("text", F.lit(NUMBERED))).select("doc_id", "para_idx", number.alias("number"), level.alias("level"), F.substring(F.trim(F.regexp_extract("text", NUMBERED, 2)), 1, 10).alias("title"))


@query("w8_heading_skips", rf"""WITH {SPEC}, {HEADINGS}, w AS (SELECT *, level > lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY para_idx) + 1 AS skip, row_number() OVER (PARTITION BY doc_id, level, trim(lower(title)) ORDER BY para_idx) > 1 AS again FROM heads)
SELECT doc_id, 'skipped_level' AS issue, para_idx AS at FROM w WHERE skip UNION ALL SELECT doc_id, 'duplicate', para_idx FROM w WHERE again
UNION ALL SELECT doc_id, 'mixed_numbering', level FROM heads GROUP BY doc_id, level HAVING count(DISTINCT CASE WHEN regexp_matches(number, '^\d+$') THEN 'plain' WHEN regexp_matches(number, '^\d+(\.\d+)+$') THEN 'dotted' ELSE 'other' END) > 1""")
def heading_skips(spark: SparkSession, sf: str) -> DataFrame:
    return S.heading_issues(headings(spark, sf))


_SHORT = "short AS (SELECT doc_id, para_idx, CASE WHEN para_idx % 8 = 0 THEN text ELSE substr(text, 1, 12) END AS text FROM spec WHERE para_idx % 8 < 3 AND (para_idx % 8 = 0 OR para_idx // 8 % 3 > 0))"


@query("w9_empty_sections", rf"""WITH {SPEC}, {_SHORT}, h AS (SELECT *, regexp_matches(trim(text), '{S.NUMBERED_LINE}') AS heads FROM short), g AS (SELECT *, count(*) FILTER (heads) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS section FROM h),
p AS (SELECT doc_id, min(para_idx) AS para_idx, sum(CASE WHEN heads THEN 0 ELSE len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) END)::BIGINT AS words FROM g WHERE section > 0 GROUP BY doc_id, section)
SELECT *, CASE WHEN words = 0 THEN 'Medium' ELSE 'Low' END AS severity FROM p WHERE words < 10""")
def empty_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of which two lines are left, cut to twelve characters, and every third has none."""
    i = F.col("para_idx") % 8
    short = spec(spark, sf).where((i < 3) & ((i == 0) | (F.floor(F.col("para_idx") / 8) % 3 > 0))).withColumn("text", F.when(i == 0, F.col("text")).otherwise(F.substring("text", 1, 12)))
    return S.empty_sections(short)


@query("w9_orphan_headings", rf"""WITH {SPEC}, h AS (SELECT doc_id, para_idx, regexp_extract(trim(text), '{S.NUMBERED_LINE}', 1) AS number FROM (SELECT doc_id, para_idx, replace(text, '.1.1 ', '.' || (para_idx // 16 % 2 + 1) || ' ') AS text FROM spec UNION ALL SELECT doc_id, para_idx, (para_idx // 8 + 2) || ' Parent' FROM spec WHERE para_idx % 16 = 1) WHERE regexp_matches(trim(text), '{S.NUMBERED_LINE}'))
SELECT DISTINCT doc_id, any_value(c.para_idx) AS para_idx, any_value(c.number) AS number FROM h p JOIN h c USING (doc_id) WHERE c.para_idx > p.para_idx AND starts_with(c.number, p.number || '.') AND len(string_split(c.number, '.')) = len(string_split(p.number, '.')) + 1 GROUP BY doc_id, p.para_idx, p.number HAVING count(*) = 1""")
def orphan_headings(spark: SparkSession, sf: str) -> DataFrame:
    s = spec(spark, sf)
    parents = s.where("para_idx % 16 = 1").select("doc_id", "para_idx", F.concat((F.floor(F.col("para_idx") / 8) + 2).cast("string"), F.lit(" Parent")).alias("text"))
    fixed = s.withColumn("text", F.replace("text", F.lit(".1.1 "), F.concat(F.lit("."), (F.floor(F.col("para_idx") / 16) % 2 + 1).cast("string"), F.lit(" "))))
    return S.orphan_headings(fixed.unionByName(parents))


@query("j8_toc_mismatches", rf"""WITH {SPEC}, {HEADINGS}, toc AS (SELECT doc_id, CASE para_idx % 3 WHEN 0 THEN title WHEN 1 THEN substr(title, 1, 4) || para_idx ELSE title || ' more' END AS entry FROM heads)
SELECT doc_id, entry, count(*) AS n FROM toc t WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = t.doc_id AND trim(lower(title)) <> '' AND (contains(trim(lower(entry)), trim(lower(title))) OR contains(trim(lower(title)), trim(lower(entry))))) GROUP BY ALL""")
def toc_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    h = headings(spark, sf)
    entry = F.when(F.col("para_idx") % 3 == 0, F.col("title")).when(F.col("para_idx") % 3 == 1, F.concat(F.substring("title", 1, 4), F.col("para_idx").cast("string"))).otherwise(F.concat("title", F.lit(" more")))
    return S.toc_mismatches(h.select("doc_id", entry.alias("entry")), h).groupBy("doc_id", "entry").agg(F.count("*").alias("n"))


ACRONYMS = r"uses AS (SELECT doc_id, para_idx, generate_subscripts(a, 1) AS pos, unnest(a) AS acronym FROM (SELECT doc_id, para_idx, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,6}')) AS a FROM spec)), defs AS (SELECT * FROM uses WHERE para_idx % 5 = 1)"


def acronyms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Capitals of the specification as uses; those of every fifth line as definitions."""
    uses = spec(spark, sf).select("doc_id", "para_idx", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda x: F.regexp_like(x, F.lit("^[A-Z]{2,6}$")))).alias("pos", "acronym"))
    return uses.where("para_idx % 5 = 1"), uses


@query("j5_acronym_order", rf"""WITH {SPEC}, {ACRONYMS}, j AS (SELECT doc_id, acronym, d, nd, u, nu FROM (SELECT doc_id, acronym, min((para_idx, pos)) AS d, count(*) AS nd FROM defs GROUP BY ALL) FULL JOIN (SELECT doc_id, acronym, min((para_idx, pos)) AS u, count(*) AS nu FROM uses GROUP BY ALL) USING (doc_id, acronym))
SELECT doc_id, acronym, 'before_definition' AS issue FROM j WHERE u < d UNION ALL SELECT doc_id, acronym, 'never_defined' FROM j WHERE d IS NULL AND nu >= 2 UNION ALL SELECT doc_id, acronym, 'never_used' FROM j WHERE d IS NOT NULL AND coalesce(nu, 0) <= 1 UNION ALL SELECT doc_id, acronym, 'defined_again' FROM j WHERE nd > 1""")
def acronym_order(spark: SparkSession, sf: str) -> DataFrame:
    return S.acronym_order_issues(*acronyms(spark, sf))


@query("w11_defined_before_used", rf"WITH {SPEC}, {ACRONYMS}, t AS (SELECT doc_id, acronym AS term, CASE WHEN para_idx % 5 = 1 THEN 'definition' ELSE 'use' END AS kind, para_idx * 1000 + pos AS pos FROM uses) SELECT doc_id, term, min(pos) FILTER (kind = 'use') AS used, min(pos) FILTER (kind = 'definition') AS defined FROM t GROUP BY ALL HAVING min(pos) FILTER (kind = 'use') < min(pos) FILTER (kind = 'definition')")
def defined_before_used(spark: SparkSession, sf: str) -> DataFrame:
    uses = acronyms(spark, sf)[1]
    return S.used_before_defined(uses.select("doc_id", F.col("acronym").alias("term"), F.when(F.col("para_idx") % 5 == 1, "definition").otherwise("use").alias("kind"), (F.col("para_idx") * 1000 + F.col("pos") + 1).alias("pos")))


@query("a37_reference_statistics", rf"""WITH {SPEC}, r AS (SELECT doc_id, 'section' AS type, regexp_extract(text, 'See Section (\d+)', 1) AS number FROM spec WHERE regexp_matches(text, 'See Section (\d+)') UNION ALL SELECT doc_id, 'requirement', (para_idx + 108)::VARCHAR FROM spec WHERE para_idx % 8 = 1),
i AS (SELECT doc_id, 'section' AS type, regexp_extract(text, '{NUMBERED}', 1) AS number FROM spec WHERE regexp_matches(text, '{NUMBERED}') UNION ALL SELECT doc_id, 'requirement', (para_idx + 100)::VARCHAR FROM spec WHERE para_idx % 8 = 1)
SELECT type, sum((k = 'r')::INTEGER)::BIGINT AS "references", sum((k = 'i')::INTEGER)::BIGINT AS items, sum((k = 'r' AND NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = b.doc_id AND i.type = b.type AND i.number = b.number))::INTEGER)::BIGINT AS broken, sum((k = 'i' AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND r.type = b.type AND r.number = b.number))::INTEGER)::BIGINT AS unreferenced
FROM (SELECT 'r' AS k, * FROM r UNION ALL SELECT 'i', * FROM i) b GROUP BY type""")
def reference_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = spec(spark, sf)
    rows = lambda where, kind, number: s.where(where).select("doc_id", F.lit(kind).alias("type"), number.alias("number"))
    see, line = r"See Section (\d+)", F.col("para_idx")
    refs = rows(F.regexp_like("text", F.lit(see)), "section", F.regexp_extract("text", see, 1)).unionByName(rows(line % 8 == 1, "requirement", (line + 108).cast("string")))
    items = rows(F.regexp_like("text", F.lit(NUMBERED)), "section", F.regexp_extract("text", NUMBERED, 1)).unionByName(rows(line % 8 == 1, "requirement", (line + 100).cast("string")))
    return S.reference_statistics(refs, items)


@query("a30_health_score", rf"""WITH {LINES}, p AS (SELECT doc_id, count(*) AS paragraphs, sum(len(regexp_extract_all(text, '[a-zA-Z]+')))::BIGINT AS words FROM lines GROUP BY 1),
t AS (SELECT doc_id, round(50 - least(50.0, CASE WHEN doc_id % 97 > 0 THEN ln(1 + (doc_id % 97) / 20.0) * 25 ELSE 0 END) + CASE WHEN doc_id % 25 > 20 THEN 5 WHEN doc_id % 25 > 18 THEN 8 WHEN doc_id % 25 > 16 THEN 12 WHEN doc_id % 25 >= 10 THEN 15 ELSE 12 END
  + least(20, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 0 END + CASE WHEN doc_id % 8 >= 5 THEN 7 WHEN doc_id % 8 >= 2 THEN 4 ELSE 0 END + CASE WHEN doc_id % 5 >= 3 THEN 6 WHEN doc_id % 5 >= 1 THEN 3 ELSE 0 END)
  + least(15, CASE WHEN doc_id % 3 >= 1 THEN 3 ELSE 0 END + CASE WHEN doc_id % 4 >= 1 THEN 3 ELSE 0 END + CASE WHEN words > 1000 THEN 5 WHEN words > 300 THEN 3 ELSE 0 END + CASE WHEN paragraphs > 5 THEN 4 WHEN paragraphs > 2 THEN 2 ELSE 0 END), 6) AS total FROM p)
SELECT doc_id, round(total, 1)::DOUBLE AS total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 65 THEN 'C' WHEN total >= 50 THEN 'D' ELSE 'F' END AS grade FROM t""")
def health_score(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    per = T.paragraphs(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.regexp_count("text", F.lit("[a-zA-Z]+"))).alias("words"))
    return S.health_score(per.select("*", (d % 97).alias("weighted"), (d % 25).alias("fk_grade"), (d % 2 == 0).alias("has_toc"), (d % 8).alias("headings"), (d % 5).alias("sections"), (d % 3).alias("tables"), (d % 4).alias("figures")))


_TYPES = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS type, {i} AS i, " + " + ".join(f"contains(t, '{w}')::INTEGER" for w in words) + " AS n FROM d" for i, (name, words) in enumerate(S.TYPE_WORDS))


@query("a33_document_type", f"WITH {SPEC}, d AS (SELECT doc_id, lower(string_agg(text, ' ' ORDER BY para_idx) || ['', ' test case validation', ' budget risk schedule', ' analysis'][doc_id % 4 + 1]) AS t FROM spec WHERE para_idx < 50 GROUP BY 1), n AS ({_TYPES}), b AS (SELECT doc_id, arg_max(type, (n, -i)) AS type, max(n) AS n FROM n GROUP BY 1) SELECT doc_id, CASE WHEN n > 0 THEN type ELSE 'general' END AS type, round(least(1.0, n / 3.0), 2)::DOUBLE AS confidence, n::INTEGER AS indicators FROM b")
def document_type(spark: SparkSession, sf: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "test case validation").when(F.col("doc_id") % 4 == 2, "budget risk schedule").otherwise("analysis")
    s = spec(spark, sf)
    return S.document_type(s.unionByName(s.select("doc_id").distinct().select("doc_id", F.lit(49).alias("para_idx"), more.alias("text"))))


#: Word boundaries are those of ASCII in the SQL's engine alone, so other characters become underscores first.
_PHRASED = "phrased AS (SELECT doc_id, para_idx, regexp_replace(text, '[^\\x01-\\x7F]', '_', 'g') || ' ' || [" + ", ".join(f"'{quoted(x)}'" for x in ("In fact, it is clear that", "More or less", "very really quite", "no failure", "not all", "was written and is shown", "")) + "][(doc_id + para_idx) % 7 + 1] AS text FROM lines)"


def phrased(spark: SparkSession, sf: str) -> DataFrame:
    more = F.element_at(F.array(*map(F.lit, ("In fact, it is clear that", "More or less", "very really quite", "no failure", "not all", "was written and is shown", ""))), ((F.col("doc_id") + F.col("para_idx")) % 7 + 1).cast("int"))
    return T.paragraphs(docs(spark, sf)).withColumn("text", F.concat_ws(" ", F.regexp_replace("text", r"[^\x01-\x7F]", "_"), more))


_F = " + ".join(f"contains(lower(text), '{p}')::INTEGER" for p in S.FILLERS)
_W = " + ".join(rf"regexp_matches(lower(text), '\b{w}\b')::INTEGER" for w in S.WEAK_WORDS)


@query("a28_filler_density", f"WITH {LINES}, {_PHRASED}, c AS (SELECT doc_id, para_idx, {_F} AS fillers, {_W} AS weak FROM phrased) SELECT *, 'padded' AS issue FROM c WHERE fillers >= 2 UNION ALL SELECT *, 'filler' FROM c WHERE fillers = 1 UNION ALL SELECT *, 'weak_words' FROM c WHERE weak >= 3")
def filler_density(spark: SparkSession, sf: str) -> DataFrame:
    return S.filler_density(phrased(spark, sf))


def _hits(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"len(regexp_extract_all(text, '(?i){quoted(p)}'))" for p in patterns)


@query("r13_negation_rules", rf"""WITH {LINES}, {_PHRASED}, w AS (SELECT doc_id, para_idx, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT doc_id, para_idx, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS w FROM phrased)),
near AS (SELECT DISTINCT s.doc_id, s.para_idx, s.i FROM w s JOIN w n ON n.doc_id = s.doc_id AND n.para_idx = s.para_idx AND n.i BETWEEN s.i - 3 AND s.i - 1 WHERE s.word IN ({", ".join(f"'{x}'" for x in S.SAFETY_TERMS)}) AND n.word IN ({", ".join(f"'{quoted(x)}'" for x in S.NEGATIONS)}))
SELECT * FROM (SELECT doc_id, para_idx, 'double_negative' AS issue, {_hits(S.DOUBLE_NEGATIVES)} AS n FROM phrased UNION ALL SELECT doc_id, para_idx, 'unclear_scope', {_hits(S.UNCLEAR_SCOPE)} FROM phrased UNION ALL SELECT doc_id, para_idx, 'negated_safety_term', count(*) FROM near GROUP BY ALL) WHERE n > 0""")
def negation_rules(spark: SparkSession, sf: str) -> DataFrame:
    return S.negation_issues(phrased(spark, sf))


@query("r6_passive_voice", rf"WITH {LINES}, {_PHRASED}, c AS (SELECT doc_id, para_idx, len(list_filter(regexp_extract_all(text, '{S.PASSIVE}', 1), lambda x: lower(x) NOT IN ('given', 'interested')))::INTEGER AS passives, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::INTEGER AS sentences FROM phrased) SELECT *, round(passives / sentences::DOUBLE, 6) AS ratio FROM c WHERE passives > 0 AND round(passives / sentences::DOUBLE, 6) > 0.3")
def passive_voice(spark: SparkSession, sf: str) -> DataFrame:
    return S.passive_voice(phrased(spark, sf), ("given", "interested"))


#: Pairs of words that the corpus has, as two spellings of one.
PAIRS = (("the", "de"), ("and", "et"), ("house", "maison"))


@query("a18_uk_us_mix", f"WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x)) AS w FROM documents), s AS (SELECT doc_id, list_filter(w, lambda x: x IN ('the', 'and', 'house')) AS uk, list_filter(w, lambda x: x IN ('de', 'et', 'maison')) AS us FROM w) SELECT doc_id, len(uk)::INTEGER AS uk, len(us)::INTEGER AS us, CASE WHEN len(uk) >= len(us) THEN 'uk' ELSE 'us' END AS majority, array_to_string(list_sort(list_distinct(CASE WHEN len(uk) >= len(us) THEN us ELSE uk END))[1:5], ',') AS minority FROM s WHERE len(uk) > 0 AND len(us) > 0")
def uk_us_mix(spark: SparkSession, sf: str) -> DataFrame:
    return S.spelling_mix(docs(spark, sf), PAIRS).withColumn("minority", F.array_join("minority", ","))


_MIX = (("contractions", r"(?i)\b\w+(?:n't|'re|'ve|'ll)\b", r"(?i)\b(?:is|are|was|were|do|does|did|have|has|had|will|would|can|could|should) not\b"), ("serial_comma", r"(?i)\w+, \w+, (?:and|or) \w+", r"(?i)\w+, \w+ (?:and|or) \w+"), ("directives", r"(?i)\bshall\b", r"(?i)\b(?:must|will)\b"), ("heading_case", r"^\d+(?:\.\d+)*\s+(?:[A-Z][\w-]*\s*)+$", r"^\d+(?:\.\d+)*\s+[A-Z][\w-]*(?:\s+[a-z].*)+$"))


@query("a20_convention_mix", f"WITH {SPEC}, c AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS convention, len(regexp_extract_all(text, '{quoted(a)}')) AS a, len(regexp_extract_all(text, '{quoted(b)}')) AS b FROM spec" for n, a, b in _MIX) + ") SELECT doc_id, convention, sum(a)::BIGINT AS first, sum(b)::BIGINT AS second FROM c GROUP BY ALL HAVING sum(a) > 0 AND sum(b) > 0")
def convention_mix(spark: SparkSession, sf: str) -> DataFrame:
    return S.convention_mix(spec(spark, sf))


@query("a21_product_name_case", "SELECT doc_id, written, n AS name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS written FROM documents) JOIN (VALUES ('The', 'the'), ('De', 'de'), ('LICENSED', 'licensed')) v(n, low) ON lower(written) = low WHERE written <> n GROUP BY doc_id, written, v.n")
def product_name_case(spark: SparkSession, sf: str) -> DataFrame:
    return S.name_case(docs(spark, sf), ("The", "De", "LICENSED"))


MAILS = ("'mailto:' || lower(replace(s_name, '#', '.')) || '@gmial.com'", "'MAILTO:a' || s_suppkey || '@b.org?subject=x'", "'mailto:a@b'", "'mailto:'", "'http://x'", "'mailto:a b@c.org,x@y.org'", "'mailto:x%40y.org, a@outlok.com'")


@query("r10_mailto_rules", f"SELECT issue, count(*) AS links FROM (SELECT CASE k WHEN 0 THEN 'meant: gmail.com' WHEN 2 THEN 'no top-level domain' WHEN 3 THEN 'no address' WHEN 4 THEN 'not a mail link' WHEN 5 THEN 'bad form: a b@c.org' WHEN 6 THEN 'meant: outlook.com' END AS issue FROM (SELECT s_suppkey % 7 AS k, [{', '.join(MAILS)}][s_suppkey % 7 + 1] AS link FROM supplier)) GROUP BY 1")
def mailto_rules(spark: SparkSession, sf: str) -> DataFrame:
    link = F.element_at(F.array(*map(F.expr, MAILS)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return table(spark, sf, "supplier").groupBy(S.mailto_issue(link).alias("issue")).agg(F.count("*").alias("links"))


@query("a72_tense_profile", rf"""WITH {SPEC}, plain AS (SELECT doc_id, regexp_replace(text, '[^\x01-\x7F]', '_', 'g') AS text FROM spec), t AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\b(?:was|were|had|did|[a-z]{{2,}}ed)\b')) AS past, len(regexp_extract_all(lower(text), '\b(?:is|are|am|has|have|do|does)\b')) AS present, (contains(lower(text), 'will') OR contains(lower(text), 'shall') OR contains(lower(text), 'going to'))::INTEGER AS future FROM plain),
p AS (SELECT doc_id, sum(past)::BIGINT AS past, sum(present)::BIGINT AS present, sum(future)::BIGINT AS future, count(*) FILTER ((past > 0)::INTEGER + (present > 0)::INTEGER + future > 1) AS inconsistent FROM t GROUP BY 1)
SELECT *, CASE WHEN greatest(past, present, future) = 0 THEN NULL WHEN past >= greatest(present, future) THEN 'past' WHEN present >= future THEN 'present' ELSE 'future' END AS dominant FROM p""")
def tense_profile(spark: SparkSession, sf: str) -> DataFrame:
    return S.tense_profile(spec(spark, sf).withColumn("text", F.regexp_replace("text", r"[^\x01-\x7F]", "_")))


_LISTED = lambda of: ", ".join(f"'{quoted(w)}'" for w in of)
_MARKED = " OR ".join(f"contains(s, '{quoted(m)}')" for m in S.FUTURE_MARKS)


@query("a72_tenses", rf"""WITH s AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^\x01-\x7F]', '_', 'g')), '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS s FROM documents),
w AS (SELECT doc_id, ({_MARKED})::INTEGER AS future, list_transform(regexp_extract_all(s, '\b[a-z]+\b'), lambda w: CASE WHEN length(w) < 2 OR w IN ({_LISTED(S.NO_VERBS)}) THEN NULL WHEN w IN ({_LISTED(S.PAST_VERBS)}) THEN 'past' WHEN w IN ({_LISTED(S.PRESENT_VERBS)}) THEN 'present'
  WHEN w LIKE '%ed' AND length(w) > 3 THEN 'past' WHEN w LIKE '%s' AND length(w) > 2 AND NOT regexp_matches(w, '(ss|us|is)$') THEN 'present' WHEN w LIKE '%ing' AND length(w) > 4 THEN 'present' END) AS t FROM s),
c AS (SELECT doc_id, future, len(list_filter(t, lambda x: x = 'past')) AS past, len(list_filter(t, lambda x: x = 'present')) AS present FROM w),
p AS (SELECT doc_id, sum(past)::BIGINT AS past, sum(present)::BIGINT AS present, sum(future)::BIGINT AS future, count(*) FILTER ((past > 0)::INTEGER + (present > 0)::INTEGER + future > 1) AS inconsistent FROM c GROUP BY 1),
a AS (SELECT doc_id, coalesce(past, 0) AS past, coalesce(present, 0) AS present, coalesce(future, 0) AS future, coalesce(inconsistent, 0) AS inconsistent FROM documents LEFT JOIN p USING (doc_id))
SELECT *, past + present + future AS verbs, CASE WHEN past + present + future = 0 THEN 'unknown' WHEN past >= greatest(present, future) THEN 'past' WHEN present >= future THEN 'present' ELSE 'future' END AS dominant FROM a""")
def tenses(spark: SparkSession, sf: str) -> DataFrame:
    return S.tenses(docs(spark, sf).withColumn("text", F.regexp_replace("text", r"[^\x01-\x7F]", "_")))
