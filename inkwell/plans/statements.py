"""Queries on statements and requirements.

The documents have no requirements, headings or lists, so every sentence is made a line of a specification, by its place
in the text (`SPEC`, the same in Spark and SQL): headings, requirements, list items, conditions, actions, references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import statements as S
from inkwell.operators.text import SENTENCE_ENDS
from inkwell.plans.metrics import cut, docs
from inkwell.registry import query, table

SPEC = f"""ss AS (SELECT doc_id, (generate_subscripts(c, 1) - 1)::INTEGER AS i, unnest(c) AS s FROM (SELECT doc_id, {cut('space')} AS c FROM documents)),
spec AS (SELECT doc_id, i AS para_idx, CASE i % 8
  WHEN 0 THEN (i // 8 + 1) || CASE WHEN i % 16 = 8 THEN '.1.1' ELSE '' END || ' Scope of ' || s
  WHEN 1 THEN '[REQ-' || (100 + i) || '] The operator shall ' || CASE WHEN i % 3 = 0 THEN 'approve and sign ' ELSE 'be informed of ' END || s
  WHEN 2 THEN 'The system must verify ' || s || ' within 5 seconds and will report'
  WHEN 3 THEN (i // 8 % 4 + 1) || ') Install the unit. The crew should review it. ' || s
  WHEN 4 THEN 'If the pressure is high, ' || s
  WHEN 5 THEN 'then the crew should not stop the pump, TBD, as appropriate. ' || s
  WHEN 6 THEN 'See Section ' || (i // 8 + 2) || ' of the QM manual. Each crew may track several units. ' || s
  ELSE s END AS text FROM ss)"""


def spec(spark: SparkSession, sf: str, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, para_idx, text) of the lines, or of those of a kind only; the others do not leave their row then."""
    clean = F.filter(F.transform(F.split("text", SENTENCE_ENDS["space"]), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    text = lambda c: c.cast("string") if not isinstance(c, str) else F.lit(c)
    says = lambda *parts: F.concat(*map(text, parts))

    def made(s: Column, i: Column) -> Column:
        block = F.floor(i / 8)
        kinds = [
            says(block + 1, F.when(i % 16 == 8, ".1.1").otherwise(""), " Scope of ", s),
            says("[REQ-", i + 100, "] The operator shall ", F.when(i % 3 == 0, "approve and sign ").otherwise("be informed of "), s),
            says("The system must verify ", s, " within 5 seconds and will report"),
            says(block % 4 + 1, ") Install the unit. The crew should review it. ", s),
            says("If the pressure is high, ", s),
            says("then the crew should not stop the pump, TBD, as appropriate. ", s),
            says("See Section ", block + 2, " of the QM manual. Each crew may track several units. ", s),
        ]
        return F.coalesce(*[F.when(i % 8 == k, kind) for k, kind in enumerate(kinds)], s)

    if only is None:
        return docs(spark, sf).select("doc_id", F.posexplode(F.transform(clean, made)).alias("para_idx", "text"))
    lines = F.transform(clean, lambda s, i: F.struct(i.alias("para_idx"), made(s, i).alias("text")))
    return docs(spark, sf).select("doc_id", F.inline(F.filter(lines, lambda x: only(x["text"]))))


def quoted(text: str) -> str:
    return text.replace("'", "''")


def directive_sql(of: str) -> str:
    phrases = "".join(f" WHEN contains(lower({of}), '{p}') THEN '{d}'" for p, d in S.DIRECTIVE_PHRASES)
    return "CASE" + phrases + "".join(rf" WHEN regexp_matches(lower({of}), '\b{w}\b') THEN '{w}'" for w in S.DIRECTIVE_WORDS) + " ELSE '' END"


def _clean_sql(of: str) -> str:
    for bad, good in S.PLAIN:
        of = f"replace({of}, '{quoted(bad)}', '{quoted(good)}')"
    return of


@query("t11_clean_text", f"SELECT doc_id, md5({_clean_sql('text || t')}) AS text_md5 FROM documents, (SELECT chr(8220) || 'a' || chr(8221) || chr(8211) || chr(8230) || chr(160) || chr(195) || chr(169) || chr(226) || chr(128) || chr(153) AS t)")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(S.clean_text(F.concat("text", F.lit("“a”–… Ã©â\u0080\u0099")))).alias("text_md5"))


@query("t12_detect_directive", f"WITH {SPEC} SELECT directive, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {directive_sql('text')} AS directive FROM spec) GROUP BY 1")
def detect_directive(spark: SparkSession, sf: str) -> DataFrame:
    return spec(spark, sf).groupBy(S.directive(F.col("text")).alias("directive")).agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("documents"))


SECTIONED = rf"""{SPEC}, h AS (SELECT *, regexp_matches(text, '{S.NUMBERED}') AS is_heading FROM spec),
g AS (SELECT *, count(*) FILTER (is_heading) OVER o AS section, last_value(CASE WHEN is_heading THEN regexp_extract(text, '{S.NUMBERED}', 1) END IGNORE NULLS) OVER o AS number FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING))"""


@query("t10_sections", rf"""WITH {SECTIONED} SELECT doc_id, section, any_value(number) AS number, max(CASE WHEN is_heading THEN md5(trim(regexp_extract(text, '{S.NUMBERED}', 2))) END) AS title_md5, least(6, len(string_split(any_value(number), '.')))::INTEGER AS level,
  count(*) FILTER (NOT is_heading)::INTEGER AS lines, md5(coalesce(string_agg(text, chr(10) ORDER BY para_idx) FILTER (NOT is_heading), '')) AS content_md5 FROM g WHERE section > 0 GROUP BY doc_id, section""")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    return S.sections(spec(spark, sf)).select("doc_id", "section", "number", F.md5("title").alias("title_md5"), "level", "lines", F.md5("content").alias("content_md5"))


STATEMENTS = rf"""{SECTIONED}, said AS (SELECT doc_id, section, number, para_idx, generate_subscripts(c, 1) AS k, unnest(c) AS sentence FROM (SELECT *, {cut('space')} AS c FROM g WHERE section > 0 AND NOT is_heading)),
led AS (SELECT *, {directive_sql('sentence')} AS directive FROM said WHERE length(sentence) >= 20),
once AS (SELECT * FROM led WHERE directive <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(substr(sentence, 1, 100)) ORDER BY para_idx, k) = 1),
stmts AS (SELECT doc_id, para_idx, number || '.' || row_number() OVER (PARTITION BY doc_id, section ORDER BY para_idx, k) AS number, directive, upper(directive[1]) || directive[2:] || ' statement ' || row_number() OVER (PARTITION BY doc_id, section, directive ORDER BY para_idx, k) AS title, sentence FROM once)"""


@query("t13_extract_statements", f"WITH {STATEMENTS} SELECT doc_id, number, directive, title, md5(sentence) AS statement_md5 FROM stmts")
def statements(spark: SparkSession, sf: str) -> DataFrame:
    return S.statements(spec(spark, sf)).select("doc_id", "number", "directive", "title", F.md5("statement").alias("statement_md5"))


VERBS = ("install", "remove", "check", "press", "see")


@query("t14_extract_steps", r"""WITH """ + SPEC + r""", k AS (SELECT *, CASE WHEN regexp_matches(trim(text), '^[-*•]\s+') THEN 'bullet' WHEN regexp_matches(trim(text), '^\d+[.)]\s+') THEN 'step' WHEN regexp_matches(trim(text), '(?i)^if\b') THEN 'condition' WHEN regexp_matches(trim(text), '(?i)^then\b') THEN 'action' WHEN regexp_matches(trim(text), '(?i)^(install|remove|check|press|see)\b') THEN 'verb' END AS kind FROM spec),
n AS (SELECT *, lead(kind) OVER o AS next_kind, lead(trim(text)) OVER o AS next_text, lag(kind) OVER o AS before FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY para_idx))
SELECT doc_id, para_idx, CASE WHEN kind = 'condition' AND next_kind = 'action' THEN 'if_then' ELSE kind END AS kind, md5(CASE WHEN kind = 'condition' AND next_kind = 'action' THEN trim(text) || ' ' || next_text ELSE regexp_replace(trim(text), '^(?:[-*•]|\d+[.)])\s+', '') END) AS text_md5
FROM n WHERE kind IS NOT NULL AND NOT (kind = 'action' AND coalesce(before, '') = 'condition')""")
def steps(spark: SparkSession, sf: str) -> DataFrame:
    return S.steps(spec(spark, sf), VERBS).select("doc_id", "para_idx", "kind", F.md5("text").alias("text_md5"))


@query("w12_if_then_chains", r"WITH " + SPEC + r""", k AS (SELECT *, regexp_matches(text, '(?i)^\s*(if|when|then|else|otherwise)\b') AS holds FROM spec),
b AS (SELECT *, holds AND (NOT coalesce(lag(holds) OVER o, false) OR regexp_matches(text, '(?i)^\s*(if|when)\b')) AS begins FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY para_idx)),
c AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS chain FROM b)
SELECT doc_id, chain, min(para_idx) AS first, count(*) AS lines, md5(string_agg(text, ' ' ORDER BY para_idx)) AS text_md5 FROM c WHERE holds GROUP BY ALL""")
def chains(spark: SparkSession, sf: str) -> DataFrame:
    return S.chains(spec(spark, sf)).select("doc_id", "chain", "first", "lines", F.md5("text").alias("text_md5"))


_ID = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in S.REQUIREMENT_IDS) + ")"
REQS = rf"""{SPEC}, reqs AS (SELECT doc_id, para_idx, text, lower(regexp_extract(text, '{S.MODAL}', 1)) AS modal, {_ID} AS req_id, nullif(trim(regexp_extract(text, '{S.PARTS}', 1)), '') AS subject, nullif(trim(regexp_extract(text, '{S.PARTS}', 2)), '') AS action,
  nullif(trim(regexp_extract(text, '{S.PARTS}', 3)), '') AS object, nullif(trim(regexp_extract(text, '{S.PARTS}', 4)), '') AS condition FROM spec WHERE regexp_matches(text, '{S.MODAL}'))"""


@query("t15_extract_requirements", f"WITH {REQS} SELECT doc_id, para_idx, modal, req_id, action, md5(concat_ws('|', subject, object, condition)) AS parts_md5 FROM reqs")
def requirements(spark: SparkSession, sf: str) -> DataFrame:
    return S.requirements(spec(spark, sf)).select("doc_id", "para_idx", "modal", "req_id", "action", F.md5(F.concat_ws("|", "subject", "object", "condition")).alias("parts_md5"))


@query("t16_extract_svo", rf"WITH {SPEC} SELECT doc_id, para_idx, trim(regexp_extract(text, '{S.SVO}', 2)) AS verb, md5(regexp_replace(trim(regexp_extract(text, '{S.SVO}', 1)), '(?i)^(?:The|A|An)\s+', '')) AS subject_md5, md5(regexp_replace(trim(regexp_extract(text, '{S.SVO}', 3)), '(?i)\s+when.*$', '')) AS object_md5 FROM spec WHERE regexp_matches(text, '{S.SVO}')")
def subject_verb_object(spark: SparkSession, sf: str) -> DataFrame:
    return S.subject_verb_object(spec(spark, sf)).select("doc_id", "para_idx", "verb", F.md5("subject").alias("subject_md5"), F.md5("object").alias("object_md5"))


_ESCAPED = " + ".join(f"contains(lower(text), '{t}')::INTEGER" for t in S.ESCAPES)
_VAGUE = " + ".join(f"regexp_matches(lower(text), '{S.word_pattern(t)}')::INTEGER" for t in S.AMBIGUOUS)
ISSUES = rf"""{REQS}, marks AS (SELECT *, len(regexp_extract_all(text, '(?i)\b(shall|must|will)\b')) > 1 AS many, regexp_matches(text, '(?i)\bshall\s+\w+\s+and\s+\w+\b') AS both_, NOT regexp_matches(text, '(?i){S.NUMBER}') AND NOT regexp_matches(text, '{S.VERIFIED}') AS untested,
  {_ESCAPED} AS escapes, {_VAGUE} AS vague, regexp_matches(text, '(?i)\bshall\s+be\s+\w+ed\b') AS passive FROM reqs),
found AS (SELECT doc_id, para_idx, 'atomicity' AS issue, 'warning' AS severity, many::INTEGER AS n FROM marks UNION ALL SELECT doc_id, para_idx, 'atomicity', 'info', both_::INTEGER FROM marks UNION ALL SELECT doc_id, para_idx, 'testability', 'warning', untested::INTEGER FROM marks
  UNION ALL SELECT doc_id, para_idx, 'escape_clause', 'error', escapes FROM marks UNION ALL SELECT doc_id, para_idx, 'ambiguous', 'warning', vague FROM marks UNION ALL SELECT doc_id, para_idx, 'modal_inconsistency', 'info', (modal = 'must')::INTEGER FROM marks
  UNION ALL SELECT doc_id, para_idx, 'modal_inconsistency', 'warning', (modal IN ('should', 'may', 'can', 'could', 'might'))::INTEGER FROM marks UNION ALL SELECT doc_id, para_idx, 'structure', 'warning', (subject IS NULL)::INTEGER FROM marks UNION ALL SELECT doc_id, para_idx, 'structure', 'info', passive::INTEGER FROM marks)"""


@query("r7_requirement_rules", f"WITH {ISSUES} SELECT doc_id, issue, severity, sum(n)::BIGINT AS issues FROM found GROUP BY ALL HAVING sum(n) > 0")
def requirement_issues(spark: SparkSession, sf: str) -> DataFrame:
    return S.requirement_issues(S.requirements(spec(spark, sf))).groupBy("doc_id", "issue", "severity").agg(F.count("*").alias("issues"))


@query("a36_requirement_statistics", f"WITH {ISSUES}, n AS (SELECT doc_id, para_idx, sum(n)::BIGINT AS n FROM found GROUP BY ALL) SELECT modal, count(*) AS requirements, count(req_id) AS with_id, sum(n)::BIGINT AS issues, round(sum(n)::BIGINT / count(*)::DOUBLE, 6) AS per_requirement FROM reqs JOIN n USING (doc_id, para_idx) GROUP BY ROLLUP (modal)")
def requirement_statistics(spark: SparkSession, sf: str) -> DataFrame:
    reqs = S.requirements(spec(spark, sf))
    return S.requirement_statistics(reqs, S.requirement_issues(reqs))


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as statements."""
    c, n = table(spark, sf, "conversations"), F.col("conv_id") + F.col("turn")
    status = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("pending"), F.lit("reviewed"), F.lit("rejected"), F.lit("confirmed")), (n % 6 + 1).cast("int"))
    text = F.element_at(F.array(F.col("text"), F.lit("12, 34"), F.concat(F.lit("Table of "), "text"), F.lit("Two words"), F.concat(F.lit("The crew shall review and must approve "), "text"), F.concat(F.lit("They will inform us, and should perform "), "text")), (F.col("turn") % 6 + 1).cast("int"))
    return c.select("conv_id", "turn", "role", text.alias("description"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("title"), F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("number"), status.alias("status"), ((n % 10) / 10).alias("confidence"), F.element_at(F.array(*map(F.lit, S.DIRECTIVE_WORDS[:5])), (n % 5 + 1).cast("int")).alias("directive"))


DESCRIBED = """stmts AS (SELECT conv_id, turn, role, [text, '12, 34', 'Table of ' || text, 'Two words', 'The crew shall review and must approve ' || text, 'They will inform us, and should perform ' || text][turn % 6 + 1] AS description, 'Turn ' || turn AS title, conv_id || '.' || turn AS number,
  [NULL, '', 'pending', 'reviewed', 'rejected', 'confirmed'][(conv_id + turn) % 6 + 1] AS status, ((conv_id + turn) % 10)::DOUBLE / 10 AS confidence, ['shall', 'must', 'will', 'should', 'may'][(conv_id + turn) % 5 + 1] AS directive FROM conversations)"""


@query("r20_flag_statements", "WITH " + DESCRIBED + r""", w AS (SELECT *, trim(description) AS d, len(list_filter(string_split_regex(trim(description), '\s+'), lambda x: x <> '')) AS words FROM stmts)
SELECT flag, count(*) AS statements, count(DISTINCT conv_id) AS conversations FROM (SELECT conv_id, unnest(list_filter([CASE WHEN words < 3 THEN 'fragment' END, CASE WHEN regexp_matches(d, '^[\d\s.,]+$') THEN 'only_digits' END, CASE WHEN words > 80 THEN 'too_long' END, CASE WHEN regexp_matches(d, '(?i)^(table|figure|note|see|ref|page)\b') THEN 'not_a_statement' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS flag FROM w) GROUP BY flag""")
def statement_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.statement_flags(described(spark, sf)).select("conv_id", F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("statements"), F.countDistinct("conv_id").alias("conversations"))


@query("r15_statement_filters", f"WITH {DESCRIBED} SELECT conv_id, turn, md5(description) AS description_md5 FROM stmts WHERE (description ILIKE '%crew%' OR title ILIKE '%crew%' OR number ILIKE '%crew%') AND coalesce(nullif(status, ''), 'pending') = 'pending' AND directive IN ('shall', 'must', 'will')")
def statement_filters(spark: SparkSession, sf: str) -> DataFrame:
    return S.find_statements(described(spark, sf), like="CREW", status="pending", directives=("shall", "must", "will")).select("conv_id", "turn", F.md5("description").alias("description_md5"))


@query("a52_review_stats", f"WITH {DESCRIBED}, s AS (SELECT coalesce(nullif(status, ''), 'pending') AS s FROM stmts) SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (s = '{x}') AS {x}" for x in ("reviewed", "pending", "rejected", "confirmed")) + " FROM s")
def review_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.review_stats(described(spark, sf))


@query("a51_statement_trends", f"WITH {DESCRIBED}, scans AS (SELECT user_id AS scan_id, max(ts) AS scan_time FROM events GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 50) SELECT scan_id, count(directive) AS total, " + ", ".join(f"count(*) FILTER (directive = '{d}') AS \"{d}\"" for d in S.DIRECTIVE_WORDS[:5]) + " FROM scans LEFT JOIN stmts ON conv_id = scan_id GROUP BY scan_id")
def statement_trends(spark: SparkSession, sf: str) -> DataFrame:
    scans = table(spark, sf, "events").groupBy(F.col("user_id").alias("scan_id")).agg(F.max("ts").alias("scan_time"))
    return S.statement_trends(scans, described(spark, sf).withColumnRenamed("conv_id", "scan_id"), 50)


@query("w6_merge_responsibilities", f"WITH {DESCRIBED}, b AS (SELECT role, CASE WHEN turn % 2 = 0 THEN description ELSE lower(description) || ' ' END AS text, conv_id * 100 + turn AS seq, (turn % 3 = 0)::INTEGER AS late FROM stmts), o AS (SELECT *, row_number() OVER (PARTITION BY role, lower(trim(text)) ORDER BY late, seq) AS place FROM b) SELECT role, md5(lower(trim(text))) AS text_md5, count(*) AS n FROM o WHERE late = 0 OR place = 1 GROUP BY ALL")
def merge_responsibilities(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("turn") % 2 == 0, F.col("description")).otherwise(F.concat(F.lower("description"), F.lit(" ")))
    b = described(spark, sf).select("role", text.alias("text"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), (F.col("turn") % 3 == 0).alias("late"))
    return S.merge_responsibilities(b.where("not late"), b.where("late")).groupBy("role", F.md5(F.lower(F.trim("text"))).alias("text_md5")).agg(F.count("*").alias("n"))


_RACI = "CASE " + " ".join(f"WHEN regexp_matches(verb, '^({'|'.join(s)})') THEN '{k}'" for k, s in S.RACI_STEMS) + " ELSE 'R' END"


@query("a41_raci", rf"""WITH {DESCRIBED}, said AS (SELECT DISTINCT role || '-' || turn AS role, trim(description) AS text FROM stmts WHERE trim(description) <> ''),
v AS (SELECT role, unnest(CASE WHEN len(m) > 0 THEN list_transform(m, lambda x: lower(x)) ELSE [''] END) AS verb FROM (SELECT role, regexp_extract_all(text, '(?i)\b(?:shall|must|will|should|may)\s+(\w+)', 1) AS m FROM said)),
n AS (SELECT role, count(*) FILTER (k = 'R') AS "R", count(*) FILTER (k = 'A') AS "A", count(*) FILTER (k = 'C') AS "C", count(*) FILTER (k = 'I') AS "I" FROM (SELECT role, {_RACI} AS k FROM v) GROUP BY role)
SELECT *, CASE greatest("R", "A", "C", "I") WHEN "R" THEN 'R' WHEN "A" THEN 'A' WHEN "C" THEN 'C' ELSE 'I' END AS main FROM n""")
def raci(spark: SparkSession, sf: str) -> DataFrame:
    return S.raci(described(spark, sf).select(F.concat_ws("-", "role", F.col("turn").cast("string")).alias("role"), F.col("description").alias("text")))


@query("s10_write_statements", f"WITH {STATEMENTS} SELECT doc_id, " + ", ".join(f"count(*) FILTER (len(string_split(number, '.')) = {i}) AS level_{i}, md5(coalesce(string_agg(title, '|' ORDER BY number) FILTER (len(string_split(number, '.')) = {i}), '')) AS titles_{i}" for i in (2, 4)) + " FROM stmts GROUP BY doc_id")
def write_statements(spark: SparkSession, sf: str) -> DataFrame:
    s = S.statements(spec(spark, sf)).select("doc_id", F.lit(0).alias("para_idx"), F.size(F.split("number", r"\.")).alias("level"), "title", F.col("number").alias("description"), F.lit(None).cast("string").alias("role"))
    titles = lambda i: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"title_{i}") != "", F.struct(f"description_{i}", f"title_{i}")))), lambda x: x[f"title_{i}"]), "|")
    return S.export_rows(s).groupBy("doc_id").agg(*[c for i in (2, 4) for c in (F.count_if(F.col(f"title_{i}") != "").alias(f"level_{i}"), F.md5(titles(i)).alias(f"titles_{i}"))])
