"""Which names are roles: an ordered cascade of rules as data, the first that fits decides, with its confidence and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources.stored import stored


@dataclass(frozen=True)
class Rule:
    """Fits a lower-case name by a pattern (but for `unless`) or by a flag: what the given lists of names say of it."""

    reason: str
    confidence: float  # 0: the name is rejected
    pattern: str = ""
    unless: str = ""
    flag: str = ""


def _whole(*words: str) -> str:
    return f"^({'|'.join(words)})$"


#: Everything down to RULES is fixed values: the words of the rules, in their order.
ACRONYMS = ("cor", "pm", "se", "lse", "ipt", "ccb", "erb", "ta", "pi", "qa", "qae", "cm", "sme", "der", "dar", "gtr", "co", "cotr", "cino", "cto", "cio", "ceo", "coo", "cfo", "pgm", "dpgm", "dba", "sa", "sysadmin")
WORKERS = ("employer", "employers", "employee", "employees", "personnel", "workers", "worker", "staff", "dispatchers", "dispatcher", "operator", "operators")
DEFENCE = (
    "government", "contractor", "subcontractor", "vendor", "supplier", "user", "users", "maintainer", "maintainers", "technician",
    "technicians", "inspector", "inspectors", "custodian", "illustrator", "editor", "author", "authors", "manager", "managers", "owner",
    "owners", "quality control", "senior management", "information owner", "lead", "leads", "pilot", "pilots", "engineer", "engineers",
)
ACADEMIC = (
    "graduate student", "graduate students", "postdoctoral researcher", "postdoctoral researchers", "research staff", "lab supervisor",
    "laboratory supervisor", "postdoc", "postdocs", "faculty member", "faculty members",
)
STARTERS = (
    "the", "a", "an", "this", "that", "all", "any", "each", "some", "contract", "provide", "ensure", "facilitate", "complete", "develop",
    "perform", "operate", "coordinate", "manage", "services", "requirements", "process", "phase", "work", "idiq", "task", "data", "report",
    "plan", "end", "wide", "construction", "calibration", "demolition", "repair", "manner", "range", "monthly", "foreign", "addition",
    "written", "final", "initial", "current", "other", "various", "responsible", "accountable", "serves", "serving", "acts", "acting",
    "works", "working", "reports", "reporting", "directly", "overall", "primary", "secondary", "main",
)
CONNECTORS = (
    "is", "are", "was", "were", "be", "being", "been", "shall", "will", "must", "may", "can", "could", "that", "which", "who", "whom",
    "whose", "so", "such", "very", "just", "only", "also", "including", "excluding", "regarding", "concerning", "for",
)
JOINED = ("manager", "engineer", "officer", "director", "lead", "analyst", "team", "coordinator", "specialist")
ENDINGS = ("begins", "ends", "various", "just", "only", "personnel", "activities", "services", "requirements", "orders", "systems", "facilities", "resources")
PLACES = (
    "center", "building", "suite", "floor", "room", "street", "avenue", "boulevard", "road", "drive", "lane", "way", "atlanta", "chicago",
    "washington", "boston", "denver", "alaska", "california", "connecticut", "hawaii", "indiana", "iowa", "federal",
)
STRONG = ("engineer", "manager", "lead", "analyst", "specialist", "coordinator", "owner", "reviewer", "approver", "author", "director", "officer", "supervisor", "architect")
PHRASES = (
    "reviewed by", "approved by", "conducted by", "coordinated with", "performed by", "verified by", "validated by", "assists the",
    "works with the", "in managing", "goes beyond", "perform various", "that optimizes", "completion of", "demand for",
)
ACTIVITIES = (
    "activities", "reviews", "specifications", "requirements", "procedures", "processes", "tasks", "efforts", "orders", "travel",
    "maintenance", "protection", "facility",
)
SUFFIXES = (
    "engineer", "manager", "lead", "director", "officer", "specialist", "analyst", "coordinator", "administrator", "authority", "chief",
    "supervisor", "inspector", "auditor", "reviewer", "approver", "representative", "owner", "custodian", "architect", "integrator",
    "technician", "scientist", "investigator", "controller", "planner", "panel", "board", "council", "committee", "team", "group",
)
MODIFIERS = (
    "project", "program", "systems", "system", "lead", "chief", "senior", "deputy", "assistant", "associate", "principal", "technical",
    "quality", "safety", "mission", "flight", "ground", "test", "integration", "verification", "validation", "configuration", "data", "risk",
    "requirements", "interface", "software", "hardware", "mechanical", "electrical", "structural", "thermal", "propulsion", "avionics",
    "reliability", "maintainability", "logistics", "operations", "security", "environmental", "human", "factors", "design",
    "manufacturing", "production", "subsystem", "component", "element", "responsible", "cognizant", "designated", "authorized",
    "certifying", "contracting", "procurement", "review", "control", "change", "engineering", "standing", "independent", "working",
    "action", "steering", "executive", "advisory",
)
TIEBREAK = (
    "engineer", "manager", "lead", "analyst", "specialist", "coordinator", "owner", "reviewer", "approver", "author", "director", "officer",
    "supervisor", "architect", "sme", "integrator", "administrator", "technician", "inspector",
)
PRODUCTS = (
    r"\b(plan|report|specification|analysis|assessment|study)\b",
    r"\b(document|manual|guide|handbook|procedure|instruction)\b",
    r"\b(drawing|schematic|diagram|model|prototype|mockup)\b",
    r"\b(database|repository|archive|library|registry)\b",
    r"\b(schedule|timeline|roadmap|milestone|gantt)\b",
    r"\b(budget|estimate|proposal|quotation|bid)\b",
    r"\b(contract|agreement|memorandum|charter)\b",
    r"\b(icd|srs|sdd|cdrl|did|sow|wbs|semp|spmp|cmp|qap)\b",
    r"\bsafety plan\b",
    r"\btest (report|results|data|log|procedure)\b",
    r"\bverification (report|results|matrix)\b",
    r"\bvalidation (report|results)\b",
    r"(^| )(plan|report|specification|document|manual|drawing|schematic|schedule|budget|proposal|matrix|database|archive|log|checklist)$",
)

_PLACE, _SUFFIX, _MODIFIER = ("|".join(x) for x in (PLACES, SUFFIXES, MODIFIERS))
RULES = (
    Rule("acronym", 0.92, _whole(*ACRONYMS)),
    Rule("worker", 0.85, _whole(*WORKERS)),
    Rule("government", 0.88, _whole(*DEFENCE)),
    Rule("academic", 0.88, _whole(*ACADEMIC)),
    Rule("too short", 0, "^.{0,3}$"),
    Rule("too many words", 0, "^[^ ]+( [^ ]+){6,}$"),
    Rule("too long", 0, "^.{61,}$"),
    Rule("phone number", 0, r"[0-9]{3}[-. ]?[0-9]{4}"),
    Rule("word that is no role", 0, flag="never"),
    Rule("begins like a phrase", 0, f"^({'|'.join(STARTERS)})( |$)"),
    Rule("connecting word", 0, f"^[^ ]+( [^ ]+){{0,2}} ({'|'.join(CONNECTORS)})( |$)"),
    Rule("two roles", 0, f"^[^ ]+( [^ ]+)* and .*({'|'.join(JOINED)})"),
    Rule("the inside", 0, "^[^ ]+( [^ ]+)+ the$|^[^ ]+( [^ ]+)* the [^ ]"),
    Rule("ends like a phrase", 0, f"(^| )({'|'.join(ENDINGS)})$"),
    Rule("place", 0, f"(^| )({_PLACE}) (.* )?({_PLACE}|[0-9]+)( |$)|(^| )[0-9]+ (.* )?({_PLACE})( |$)", "(^| )(administrator|director|manager|officer)( |$)"),
    Rule("of one's own", 0, "^own( |$)"),
    Rule("known to be none", 0, flag="none"),
    Rule("known role", 0.95, flag="known"),
    Rule("strong suffix", 0.90, f"[^ ] ?({'|'.join(STRONG)})$"),
    Rule("part is known to be none", 0, flag="part_none"),
    Rule("phrase", 0, "|".join(PHRASES)),
    Rule("fragment", 0, "^(manager assists|engineer analyzes)"),
    Rule("activity", 0, f"({'|'.join(ACTIVITIES)})$", "engineer|manager|lead|officer"),
    Rule("suffix and modifier", 0.90, f"(^| )({_MODIFIER}) (.* )?[^ ]*({_SUFFIX})$"),
    Rule("suffix", 0.75, f"^[^ ]+( [^ ]+)? ({_SUFFIX})$|^([^ ]+ )?[^ ]+({_SUFFIX})$"),
    Rule("suffix of a long name", 0.60, f"[^ ] ?({_SUFFIX})$"),
    Rule("suffix alone", 0.50, _whole(*SUFFIXES)),
    Rule("suffix inside", 0.65, f"(^| )({_SUFFIX})( |$)"),
    Rule("modifier first", 0.55, f"^({_MODIFIER}) "),
    Rule("holds a known role", 0.70, flag="part_known"),
)
NO_RULE = "no rule"


def cleaned(name: Column) -> Column:
    """A name in lower case with single spaces and without an acronym in brackets; '' for what cannot be a name.

    That is what begins with a digit, has a phone or post code, an alternative, digits for over 30 % of it, or is a numbered
    heading.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\([A-Z][A-Z&/]{1,7}\)\s*", " "), r"\s+", " "))
    digits = F.regexp_count(bare, F.lit("[0-9]"))
    out = F.regexp_like(bare, F.lit(r"^[0-9]|[0-9]{3}[-. ]?[0-9]{4}|\([0-9]{3}\)|\b[0-9]{5}\b|/|^[A-Z0-9]+\. ")) | (digits > 0.3 * F.length(bare))
    return F.when(out, "").otherwise(F.lower(bare))


def _runs(names: DataFrame) -> DataFrame:
    """(name, run, edge): the runs of words of a name; edge if a run begins or ends a longer name."""
    w, n = F.split("name", " "), F.size(F.split("name", " "))
    every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.struct(F.array_join(F.slice(w, i, j - i + 1), " ").alias("run"), (((i == 1) | (j == n)) & ~((i == 1) & (j == n))).alias("edge")))))
    return names.where((F.col("name") != "") & (n <= 6)).select("name", F.inline(every))


def valid_role_names(names: DataFrame, known: DataFrame, none: DataFrame, never: DataFrame) -> DataFrame:
    """(name, valid, confidence, reason, kind) of every distinct cleaned name; names and lists: (name).

    `known` are roles, `none` are names that are none, alone or at an edge of a longer one, `never` single words that are
    none. The first rule that fits decides. Kind is role, deliverable, false_positive or unknown; a last word of TIEBREAK makes
    a role of what would be a deliverable. A part of a name is known only as whole words. Names that cannot be cleaned go.
    Names are read once, and one that comes often is cleaned once.
    """
    said = stored(names.select("name").distinct())  # stored, or the cleaning would go before the distinct, to every row
    own = stored(said.select(cleaned(F.col("name")).alias("name")).where("name <> ''").distinct())
    listed = lambda df, to: df.select(F.lower("name").alias("name")).distinct().withColumn(to, F.lit(True))
    runs = _runs(own)
    parts = runs.where("edge").join(none.select(F.lower("name").alias("run")).distinct(), "run").select("name").distinct().withColumn("part_none", F.lit(True))
    held = runs.join(known.select(F.lower("name").alias("run")).distinct(), "run").where(F.length("name") < F.length("run") + 15).select("name").distinct().withColumn("part_known", F.lit(True))
    flagged = own
    for df in (listed(known, "known"), listed(none, "none"), listed(never.where("name NOT LIKE '% %'"), "never"), parts, held):
        flagged = flagged.join(df, "name", "left")
    name = F.col("name")

    def fits(r: Rule) -> Column:
        if r.flag:
            return F.coalesce(F.col(r.flag), F.lit(False))
        fit = F.regexp_like(name, F.lit(r.pattern))
        return fit & ~F.regexp_like(name, F.lit(r.unless)) if r.unless else fit

    first = F.coalesce(*[F.when(fits(r), F.struct(F.lit(float(r.confidence)).alias("confidence"), F.lit(r.reason).alias("reason"))) for r in RULES], F.struct(F.lit(0.0).alias("confidence"), F.lit(NO_RULE).alias("reason")))
    judged = flagged.withColumn("r", first).select("name", (F.col("r.confidence") > 0).alias("valid"), "r.confidence", "r.reason", F.coalesce("none", F.lit(False)).alias("none"))
    kind = F.when(F.regexp_like(name, F.lit(f"(^| )({'|'.join(TIEBREAK)})$")), "role").when(F.regexp_like(name, F.lit("|".join(PRODUCTS))), "deliverable").when(F.col("valid"), "role").when(F.col("none"), "false_positive").otherwise("unknown")
    return judged.select("name", "valid", "confidence", "reason", kind.alias("kind"))
