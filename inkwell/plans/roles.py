"""Query on role names; the SQL states the same ordered rules by CASE, and the lists by subqueries over runs of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import roles as R
from inkwell.operators import text as T
from inkwell.plans.metrics import TOKENS, docs
from inkwell.plans.similar import BENCH, dictionary
from inkwell.registry import query

#: The documents name no roles, so names are made of their words by these forms, by a word's place in its text.
FORMS = (
    "Project {} Manager", "the {} team", "{} Engineer (SE)", "{} Report", "Test {} Report Engineer", "employees", "{} and lead engineer", "{} shall be",
    "Own {} Group", "{} Board", "Chief {}", "{}", "Suite {} 12 floor", "{} control", "Senior {} of flight {} and {} data steering board", "call {} 555-1234",
    "{} reviews", "Deputy {} council member", "COR", "{} Mission Assurance",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fits(r: R.Rule) -> str:
    if r.flag:
        return r.flag
    return f"regexp_matches(name, {_quoted(r.pattern)})" + (f" AND NOT regexp_matches(name, {_quoted(r.unless)})" if r.unless else "")


_CASES = " ".join(f"WHEN {_fits(r)} THEN {i}" for i, r in enumerate(R.RULES))
_RULES = ", ".join(f"({i}, {r.confidence}::DOUBLE, {_quoted(r.reason)})" for i, r in enumerate((*R.RULES, R.Rule(R.NO_RULE, 0))))
#: From `found` (name) and `dict` to every distinct name's flags, and to the rule that decides.
JUDGED = rf"""names AS (SELECT DISTINCT lower(name) AS name FROM found WHERE name <> '' AND NOT regexp_matches(name, '^[0-9]|[0-9]{{3}}[-. ]?[0-9]{{4}}|\([0-9]{{3}}\)|\b[0-9]{{5}}\b|/|^[A-Z0-9]+\. ') AND length(regexp_replace(name, '[^0-9]', '', 'g')) <= 0.3 * length(name)),
known_roles AS (SELECT word || ' board' AS name FROM dict UNION SELECT 'test director'), no_roles AS (SELECT word || ' control' AS name FROM dict UNION SELECT 'mission assurance'), never_roles AS (SELECT word AS name FROM dict),
split AS (SELECT name, string_split(name, ' ') AS w FROM names WHERE len(string_split(name, ' ')) <= 6),
runs AS (SELECT name, array_to_string(w[i:j], ' ') AS run, (i = 1 OR j = len(w)) AND NOT (i = 1 AND j = len(w)) AS edge FROM split, unnest(range(1, 7)) a(i), unnest(range(1, 7)) b(j) WHERE i <= j AND j <= len(w)),
flags AS (SELECT name, name IN (SELECT name FROM known_roles) AS known, name IN (SELECT name FROM no_roles) AS none, name IN (SELECT name FROM never_roles) AS never,
  name IN (SELECT r.name FROM runs r JOIN no_roles n ON r.run = n.name WHERE edge) AS part_none, name IN (SELECT r.name FROM runs r JOIN known_roles n ON r.run = n.name WHERE length(r.name) < length(r.run) + 15) AS part_known FROM names),
decided AS (SELECT *, CASE {_CASES} ELSE {len(R.RULES)} END AS rule FROM flags), rules(rule, confidence, reason) AS (VALUES {_RULES}),
judged AS (SELECT name, confidence > 0 AS valid, confidence, reason, CASE WHEN regexp_matches(name, '(^| )({"|".join(R.TIEBREAK)})$') THEN 'role' WHEN regexp_matches(name, {_quoted("|".join(R.PRODUCTS))}) THEN 'deliverable' WHEN confidence > 0 THEN 'role' WHEN none THEN 'false_positive' ELSE 'unknown' END AS kind
  FROM decided JOIN rules USING (rule))"""
SQL = rf"""WITH {TOKENS}, {BENCH}, forms(k, form) AS (VALUES {", ".join(f"({i}, {_quoted(f)})" for i, f in enumerate(FORMS))}),
found AS (SELECT trim(regexp_replace(regexp_replace(replace(form, '{{}}', word), '\s*\([A-Z][A-Z&/]{{1,7}}\)\s*', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM tokens JOIN forms ON pos % {len(FORMS)} = k),
{JUDGED} SELECT * FROM judged"""


def lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known roles, names that are none and words that are none, made of the benchmark's words."""
    words = dictionary(spark, sf).select("word")
    with_end = lambda end, more: words.select(F.concat("word", F.lit(end)).alias("name")).unionByName(spark.createDataFrame([(more,)], "name string"))
    return with_end(" board", "test director"), with_end(" control", "mission assurance"), words.select(F.col("word").alias("name"))


@query("r18_valid_role_names", SQL)
def valid_role_names(spark: SparkSession, sf: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, FORMS)), F.col("k"))
    places = T.tokens(docs(spark, sf)).select("word", (F.col("pos") % len(FORMS) + 1).cast("int").alias("k")).distinct()
    names = places.select(F.replace(form, F.lit("{}"), F.col("word")).alias("name"))
    return R.valid_role_names(names, *lists(spark, sf))
