"""Queries on roles in text; the SQL scans the same patterns by DuckDB's expressions and states each step after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import mentions as M
from inkwell.plans.roles import JUDGED, lists
from inkwell.plans.similar import BENCH
from inkwell.plans.statements import SPEC, quoted, spec
from inkwell.registry import query

#: The documents name no roles, so each sentence goes on from one of these, by its place in the text.
BEGINNINGS = (
    "The Systems Engineer shall review ",
    "Reports are approved by the Quality Manager and the Test Director, who check ",
    "The Project Manager's responsibility is to track ",
    "Responsibilities of the Safety Engineer include ",
    "The Project Manager (PM) is responsible for ",
    "She serves as the Chief Engineer in this. Notify the Program Managers before ",
    "Lead Design Engineer ensures quality; and more. Work is verified by the Change Control Board. Then ",
    "It needs approval from the Technical Leads and the Configuration Manager, for ",
    "The Sys Engineer assists the crew. The integrator supports the ",
    "Tests are conducted by Test Engineers and prepared by the Report Author. ",
    "The Vendor develops. Operators shall stop. The Flight Plan is seen by the Review Board. ",
    "",
)


def _values(*rows: tuple[str, ...]) -> str:
    return ", ".join("(" + ", ".join(quoted_text(v) for v in r) + ")" for r in rows)


def quoted_text(text: str) -> str:
    return "'" + quoted(text) + "'"


def _scan(rank: int, p: M.Pattern) -> str:
    names = "[regexp_extract(hit, {0}, 2), regexp_extract(hit, {0}, 3)]" if p.both else "[regexp_extract(hit, {0}, 2)]"
    before = "CASE WHEN starts_with(hit, '.') THEN before || '.' ELSE '' END" if p.begins_at_end() else "''"
    after = "coalesce(next, '')" if p.takes_the_stop() else "''"
    r = quoted_text(p.regex())
    return f"""SELECT doc_id, para_idx, sent_idx, place AS spot, {rank} AS rank, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS part, trim(regexp_replace(context, '\\s+', ' ', 'g')) AS context
FROM (SELECT *, {names.format(r)} AS names, {before} || own || {after} AS context FROM (SELECT *, hits[i] AS hit, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) + 1 - (sent_idx > 0)::INTEGER AS place
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT *, regexp_extract_all(unit, {r}) AS hits, string_split_regex(unit, {r}) AS gaps FROM units))))"""


_STRIPPED = "' ' || one"
for _pattern, _groups in M.STRIP:
    _STRIPPED = f"regexp_replace({_STRIPPED}, {quoted_text(_pattern)}, '" + "".join(rf"\{g}" for g in _groups) + "')"
_KNOWN, _FOLDED = {}, {}
for _main, _others in M.ALIASES.items():
    for _other in (_main, *_others):
        _KNOWN.setdefault(_other.lower(), _main)
for _main in M.ALIASES:
    _FOLDED.setdefault(_main.lower().replace("systems", "system").replace("engineers", "engineer"), _main)
_ABBREVIATIONS = ", ".join(map(quoted_text, M.ABBREVIATIONS))
_VERBS = ", ".join(f"({i}, {quoted_text(v)}, {quoted_text(a)})" for i, (v, a) in enumerate(M.VERBS))
FOUND = rf"""{BENCH}, {SPEC},
lines AS (SELECT doc_id, para_idx, [{", ".join(map(quoted_text, BEGINNINGS))}][para_idx % {len(BEGINNINGS)} + 1] || regexp_replace(text, '[^\x01-\x7F]', '_', 'g') AS text FROM spec),
cuts AS (SELECT doc_id, para_idx, string_split(text, '.') AS c FROM lines),
pieces AS (SELECT doc_id, para_idx, generate_subscripts(c, 1) - 1 AS sent_idx, unnest(c) AS piece, c FROM cuts),
units AS (SELECT doc_id, para_idx, sent_idx, CASE WHEN sent_idx > 0 THEN c[sent_idx] END AS before, piece || CASE WHEN sent_idx + 1 < len(c) THEN '.' ELSE '' END AS own, c[sent_idx + 2] || CASE WHEN sent_idx + 2 < len(c) THEN '.' ELSE '' END AS next, CASE WHEN sent_idx > 0 THEN '.' ELSE '' END || own AS unit FROM pieces),
hits AS ({" UNION ALL ".join(_scan(i, p) for i, p in enumerate(M.PATTERNS))}),
ones AS (SELECT *, trim(regexp_replace(name, '\s+', ' ', 'g')) AS one, string_split(trim(regexp_replace(name, '\s+', ' ', 'g')), ' ') AS w FROM hits),
cleaned AS (SELECT * EXCLUDE (name, one, w), CASE WHEN len(w) = 1 AND length(one) > 10 AND (regexp_matches(one, '[a-z][A-Z]') OR regexp_matches(lower(one), '^(?:{"|".join(M.RUN_TOGETHER)})') ) OR len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{{1,2}}$'))) >= 3
  OR len(w) >= 3 AND regexp_matches(one, {quoted_text(M.TITLED)}) AND length(replace(one, ' ', '')) < 4 * len(w) THEN '' ELSE trim({_STRIPPED}) END AS name FROM ones),
found AS (SELECT * FROM cleaned WHERE name <> ''), {JUDGED},
known_as(low, main) AS (VALUES {_values(*_KNOWN.items())}), folded_as(fold, main) AS (VALUES {_values(*_FOLDED.items())}),
titled AS (SELECT f.*, confidence, kind, array_to_string(list_transform(string_split(f.name, ' '), lambda x: CASE WHEN upper(x) IN ({_ABBREVIATIONS}) THEN upper(x) ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS titled FROM found f JOIN judged j ON lower(f.name) = j.name WHERE valid),
named AS (SELECT t.*, coalesce(k.main, o.main, titled) AS role FROM titled t LEFT JOIN known_as k ON lower(titled) = low LEFT JOIN folded_as o ON replace(replace(lower(titled), 'systems', 'system'), 'engineers', 'engineer') = fold),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY doc_id, para_idx, sent_idx, spot, role ORDER BY rank, part) = 1),
after AS (SELECT *, CASE WHEN strpos(lower(context), lower(name)) > 0 THEN trim(substr(context, strpos(lower(context), lower(name)) + length(name))) ELSE '' END AS after FROM firsts),
verbs(v_rank, verb, act) AS (VALUES {_VERBS}),
said AS (SELECT *, regexp_extract_all(lower(substr(after, 1, 100)), '\w+') AS said FROM after),
chosen AS (SELECT s.*, list_filter((SELECT list(verb ORDER BY v_rank) FROM verbs), lambda v: list_contains(said, v))[1] AS verb FROM said s),
rests AS (SELECT c.*, act, trim(substr(after, length(regexp_extract(substr(after, 1, 100), '(?i)^(.*?\b' || c.verb || ')\b', 1)) + 1)) AS rest, trim(regexp_extract(after, {quoted_text(M.DID)}, 1)) AS done FROM chosen c LEFT JOIN verbs v ON c.verb = v.verb),
mentions AS (SELECT doc_id, para_idx, sent_idx, spot, role, name, [{", ".join(quoted_text(p.name) for p in M.PATTERNS)}][rank + 1] AS pattern, confidence, kind, coalesce(act, CASE WHEN done <> '' THEN 'performs' ELSE 'unknown' END) AS action,
  CASE WHEN act IS NULL THEN done WHEN regexp_matches(rest, '[.;]') THEN trim(regexp_extract(rest, '^[^.;]*')) ELSE trim(substr(rest, 1, 100)) END AS responsibility, context FROM rests)"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    beginning = F.element_at(F.array(*map(F.lit, BEGINNINGS)), (F.col("para_idx") % len(BEGINNINGS) + 1).cast("int"))
    lines = spec(spark, sf).withColumn("text", F.concat(beginning, F.regexp_replace("text", r"[^\x01-\x7F]", "_")))
    return M.role_mentions(lines, *lists(spark, sf))


@query("t17_role_mentions", f"WITH {FOUND} SELECT doc_id, para_idx, sent_idx, spot, role, name, pattern, confidence, kind, action, md5(responsibility) AS responsibility_md5, md5(context) AS context_md5 FROM mentions")
def role_mentions(spark: SparkSession, sf: str) -> DataFrame:
    found = mentions(spark, sf)
    return found.select(*[c for c in found.columns if c not in ("responsibility", "context")], F.md5("responsibility").alias("responsibility_md5"), F.md5("context").alias("context_md5"))


@query("a42_role_document_counts", f"WITH {FOUND} SELECT role, doc_id, count(*) AS mentions, count(DISTINCT action) AS actions FROM mentions WHERE kind <> 'deliverable' GROUP BY ALL")
def role_document_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.role_document_counts(mentions(spark, sf))


@query("f11_action_types", f"WITH {FOUND} SELECT role, action, count(*) AS mentions, count(DISTINCT doc_id) AS documents, count(*) FILTER (responsibility <> '') AS with_task FROM mentions GROUP BY ALL")
def action_types(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("role", "action").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("responsibility") != "").alias("with_task"))
