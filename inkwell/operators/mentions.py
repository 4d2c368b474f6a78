"""Roles named in running text: patterns around a capitalised name, cleaned, judged, under one name, with what the role does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.graph import with_hubs
from inkwell.operators.roles import valid_role_names
from inkwell.sources.stored import stored


@dataclass(frozen=True)
class Pattern:
    """What stands around a role's name; <k> is a name of up to k words more than one, `end` follows and is not part of it."""

    name: str
    body: str
    end: str = ""
    both: bool = False  # the second name counts as well

    def regex(self) -> str:
        """Group 1 is the match, 2 its name and 3 its second name (patterns without one have none)."""
        body = self.body
        for k in "1234567890":
            body = body.replace(f"<{k}>", rf"([A-Z][a-zA-Z]+(?:\s+[a-zA-Z]+){{0,{k}}}?)")
        return f"({body}){self.end}"

    def needs(self) -> str:
        """What every match holds, for linear matching (RE2): the expression without word bounds, with Java's white space."""
        return self.regex().replace(r"\b", "").replace(r"[\s", r"[\s\x0b").replace(r"\s+", r"[\s\x0b]+").replace(r"\s*", r"[\s\x0b]*")

    def begins_at_end(self) -> bool:
        """The match may begin with the full stop of the sentence before."""
        return self.body.startswith(r"(?:^|\.")

    def takes_the_stop(self) -> bool:
        """The match takes its own sentence's full stop."""
        return self.body.endswith(r"\.")


#: Everything down to DID is fixed values: patterns in order, words and names.
CLAUSE_END = r"(?:\s*[,\.\;]|\s+(?:and|or|who|for|in|on|at|as|prior|before|after)\b)"
SHORT_END = r"(?:\s*[,\.\;]|\s+(?:and|or|who|for|in|on|at)\b)"
MARK_END = r"(?:\s*[,\.\;])"
PATTERNS = (
    Pattern("the_role", r"\b[Tt]he\s+<5>\s+(?:shall|will|has\s+(?:overall\s+)?responsibility|is\s+(?:skilled|responsible)|ensures?|provides?|reviews?|approves?|manages?|coordinates?|performs?|maintains?|leads?|oversees?|plays|usually|monitors?)"),
    Pattern("role_is", r"\b<5>\s+(?:is\s+responsible\s+for|shall\s+\w|will\s+(?:be|ensure|provide|review|approve|manage))"),
    Pattern("by_role", r"(?:by|to|from|with)\s+the\s+<4>", CLAUSE_END),
    Pattern("action_by", r"(?:approved|reviewed|coordinated|submitted|verified|validated|signed|certified|authorized|prepared|developed|conducted|performed)\s+(?:by|with)\s+(?:the\s+)?<4>", CLAUSE_END),
    Pattern("possessive", r"<4>'s\s+(?:responsibility|role|duties|function|authority|approval)"),
    Pattern("responsibilities_of", r"(?:responsibilities?|roles?|duties|functions?|authority)\s+of\s+(?:the\s+)?<4>", r"(?:\s*[,\.\;]|\s+(?:and|or|include|are|is)\b)"),
    Pattern("acronym", r"([A-Z][a-zA-Z]+(?:[\s&]+[a-zA-Z]+){0,5}?)\s*\([A-Z][A-Z&/]{1,7}\)"),
    Pattern("as_role", r"(?:as\s+(?:the\s+)?|serve\s+as\s+(?:the\s+)?|acting\s+(?:as\s+)?(?:the\s+)?)<4>", SHORT_END),
    Pattern("notify", r"(?:notify|inform|contact|consult|report\s+to)\s+(?:the\s+)?<4>", r"(?:\s*[,\.\;]|\s+(?:and|or|who|for|in|on|at|prior|before|after)\b)"),
    Pattern("sentence_start", r"(?:^|\.\s+)<4>\s+(?:shall|will|must|should|is\s+responsible|ensures?|provides?|reviews?|approves?|manages?|coordinates?|performs?|maintains?|leads?|oversees?)"),
    Pattern("end_of_sentence", r"(?:approved|reviewed|verified|validated|signed|authorized|certified)\s+by\s+(?:the\s+)?([A-Z][a-zA-Z]+(?:\s+[a-zA-Z]+){1,4}?)\s*\."),
    Pattern("role_and", r"(?:by|with|to)\s+(?:the\s+)?<3>\s+and\s+(?:the\s+)?<3>", r"(?:\s*[,\.\;]|\s+(?:who|for|in|on|at)\b)", both=True),
    Pattern("from_role", r"(?:from|require(?:s)?\s+(?:approval\s+)?from)\s+(?:the\s+)?<4>", SHORT_END),
    Pattern("role_assists", r"\b[Tt]he\s+<4>\s+(?:assists?|works?\s+with|supports?|helps?)"),
    Pattern("conducted_by", r"conducted\s+by\s+(?:the\s+)?<4>\s+and"),
    Pattern("role_action_object", r"\b[Tt]he\s+<3>\s+(?:analyzes?|assembles?|processes?|develops?|creates?|builds?|designs?|tests?|integrates?)"),
    Pattern("role_in", r"\b(?:the\s+)?<4>\s+in\s+managing"),
    Pattern("approval_from", r"(?:require|requires)\s+(?:approval\s+)?from\s+(?:the\s+)?<3>\s+and\s+(?:the\s+)?<3>", MARK_END),
    Pattern("lead_role", r"\b(?:The\s+)?([Ll]ead\s+[a-zA-Z]+(?:\s+[a-zA-Z]+){0,2}?)\s+(?:shall|will|ensures?|provides?|is\s+responsible|has)"),
    Pattern("performed_by_and", r"(?:performed|conducted|reviewed|approved|verified)\s+by\s+(?:the\s+)?<3>\s+and\s+(?:the\s+|approved\s+by\s+(?:the\s+)?)?<3>", MARK_END),
    Pattern("by_multi_word", r"by\s+(?:the\s+)?([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,4}?)\s*\."),
    Pattern("as_performed", r"as\s+performed\s+by\s+(?:the\s+)?<4>", r"\s+and"),
    Pattern("role_supports", r"\b[Tt]he\s+([a-zA-Z]+(?:\s+[a-zA-Z]+){0,3}?)\s+(?:supports?|assists?)\s+(?:the\s+)?"),
    Pattern("approval_chain", r"approval\s+from\s+(?:the\s+)?<3>\s+and\s+(?:the\s+)?<3>", MARK_END),
)
BOUNDARY = (
    "and", "or", "who", "which", "that", "with", "for", "in", "on", "at", "as", "to", "from", "by", "is", "are", "was", "were", "has", "have",
    "had", "shall", "will", "may", "can", "should", "must", "could", "would", "the", "a", "an", "this", "that", "these", "those", "their",
    "its", "prior", "before", "after", "during", "while", "when", "if", "unless",
)
LEADS = ("technical", "team", "project", "program", "system", "software", "hardware", "test", "qa", "quality", "safety", "design", "integration")
LAST_VERBS = (
    "analyzes", "assembles", "processes", "develops", "creates", "builds", "designs", "tests", "integrates", "works", "assists", "monitors",
    "reviews", "approves", "verifies", "validates", "analyzed", "assembled", "processed", "developed", "created", "performs", "coordinates",
    "manages", "ensures", "provides", "maintains", "oversees", "supports", "implements", "analyzing", "assembling", "processing",
    "developing", "creating", "building", "designing", "testing", "integrating", "working", "assisting", "monitoring", "reviewing",
    "approving", "verifying", "system", "reliability", "components", "data", "requirements", "specifications", "documents", "activities",
    "functions", "interfaces", "design", "analysis", "report", "documentation",
)
FIRST_VERBS = ("shall", "will", "may", "can", "should", "must", "performs", "coordinates", "manages", "ensures", "provides", "reviews", "approves", "verifies", "validates", "monitors")
CUT_AT = ("analyzes system", "assembles components", "processes data", "develops requirements", "creates documents", "performs analysis", "conducts review", "provides support", "manages project")
RUN_TOGETHER = ("bythe", "bya", "tothe", "forthe", "ofthe", "inthe", "onthe", "atthe", "asthe", "isthe", "thepersonnel", "thedifference", "theaccountable", "sufficientmanagement", "thecoordinate", "thecertificate")
ABBREVIATIONS = ("PM", "SE", "LSE", "IPT", "COR", "GTR", "DER", "DAR", "CCB", "ERB", "TRB", "IRT", "SRB", "OCE", "MDAA", "QA", "MA", "SMA", "IT", "IV&V", "IVV", "PP&C", "ICWG")
ALIASES = {
    "Systems Engineer": ("System Engineer", "Systems Engineers", "System Engineers", "Sys Engineer"),
    "Software Engineer": ("Software Engineers", "SW Engineer", "SW Engineers"),
    "Hardware Engineer": ("Hardware Engineers", "HW Engineer", "HW Engineers"),
    "Quality Assurance": ("Quality Assurance Engineer", "QA Engineer", "QA", "Quality Engineer"),
    "Project Manager": ("Project Managers", "Proj Manager", "PM"),
    "Program Manager": ("Program Managers", "Prog Manager"),
    "Test Engineer": ("Test Engineers", "Testing Engineer", "Test Eng"),
    "Safety Engineer": ("Safety Engineers", "System Safety Engineer", "Systems Safety Engineer"),
    "Reliability Engineer": ("Reliability Engineers", "Rel Engineer"),
    "Integration Engineer": ("Integration Engineers", "Integrator", "System Integrator"),
    "Configuration Manager": ("Configuration Management", "CM", "Config Manager"),
    "Technical Lead": ("Tech Lead", "Technical Leads", "Tech Leads"),
    "Chief Engineer": ("Chief Engineers", "CE", "Chief Eng"),
    "Lead Engineer": ("Lead Engineers", "Lead Eng"),
    "Requirements Engineer": ("Requirements Engineers", "Req Engineer", "Requirements Analyst"),
    "Design Engineer": ("Design Engineers", "Designer"),
    "Verification Engineer": ("Verification Engineers", "V&V Engineer", "Verification"),
    "Validation Engineer": ("Validation Engineers", "Validation"),
    "Subcontractor": ("Subcontractors", "Sub-Contractor", "Sub Contractor"),
    "Contractor": ("Contractors", "Prime Contractor"),
    "Customer": ("Customers", "Client", "End User"),
    "Government": ("Government Representative", "Govt", "Government Customer"),
}
ACTIONS = {
    "performs": ("perform", "performs", "performing", "execute", "executes", "conduct", "conducts", "conducting"),
    "approves": ("approve", "approves", "approving", "authorize", "authorizes", "sign", "signs", "certify", "certifies"),
    "reviews": ("review", "reviews", "reviewing", "evaluate", "evaluates", "assess", "assesses", "examine", "examines"),
    "coordinates": ("coordinate", "coordinates", "coordinating", "collaborate", "collaborates", "liaise", "liaises"),
    "manages": ("manage", "manages", "managing", "oversee", "oversees", "direct", "directs", "supervise", "supervises"),
    "supports": ("support", "supports", "supporting", "assist", "assists", "help", "helps", "aid", "aids"),
    "verifies": ("verify", "verifies", "verifying", "validate", "validates", "confirm", "confirms", "check", "checks"),
    "develops": ("develop", "develops", "developing", "create", "creates", "design", "designs", "prepare", "prepares"),
    "maintains": ("maintain", "maintains", "maintaining", "update", "updates", "sustain", "sustains"),
    "ensures": ("ensure", "ensures", "ensuring", "guarantee", "guarantees", "assure", "assures"),
    "provides": ("provide", "provides", "providing", "supply", "supplies", "deliver", "delivers"),
    "receives": ("receive", "receives", "receiving", "obtain", "obtains"),
    "reports": ("report", "reports", "reporting", "communicate", "communicates", "inform", "informs"),
    "defines": ("define", "defines", "defining", "specify", "specifies", "establish", "establishes"),
    "implements": ("implement", "implements", "implementing", "deploy", "deploys"),
    "leads": ("lead", "leads", "leading"),
    "monitors": ("monitor", "monitors", "monitoring", "track", "tracks", "tracking"),
}
DID = r"(?i)is\s+responsible\s+for\s+(.{10,100}?)(?:\.|;|$)"

VERBS = tuple((verb, action) for action, verbs in ACTIONS.items() for verb in verbs)
#: Steps that clean a name whose every word has a space before it: a pattern and what replaces it.
STRIP = (
    (f"(?i)(?: (?:{'|'.join(BOUNDARY)}))+$", ""),
    (f"(?i)^(?: (?:{'|'.join(BOUNDARY)}))+( |$)", "1"),
    (f"(?i)( (?:{'|'.join(LEADS)}) leads)$|( [^ ]+) leads$", "12"),
    (f"(?i)(?: (?:{'|'.join(LAST_VERBS)}))+$", ""),
    (f"(?i)^(?: (?:{'|'.join(FIRST_VERBS)}))+( |$)", "1"),
    (f"(?i)^(.+?)(?:{'|'.join(CUT_AT)}).*$", "1"),
)
BROKEN = rf"^([^ ]{{11,}})$"
TITLED = r"^(?:[A-Z][a-z]*|[^ ]*&[^ ]*)(?: (?:[A-Z][a-z]*|[^ ]*&[^ ]*))*$"


def candidate(name: Column) -> Column:
    """A found name without the words at its edges that belong to the sentence; '' for words run together or torn apart.

    Run together: one word of over 10 letters with a capital inside or a beginning like `ofthe`. Torn apart: four words or
    more of which three have at most two letters, or three capitalised words or more of under 4 letters on average.
    """
    one = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    words = F.split(one, " ")
    n = F.size(words)
    together = (n == 1) & (F.length(one) > 10) & (F.regexp_like(one, F.lit("[a-z][A-Z]")) | F.regexp_like(F.lower(one), F.lit(f"^(?:{'|'.join(RUN_TOGETHER)})")))
    short = F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit("^[A-Za-z]{1,2}$"))))
    torn = ((n >= 4) & (short >= 3)) | ((n >= 3) & F.regexp_like(one, F.lit(TITLED)) & (F.length(F.replace(one, F.lit(" "), F.lit(""))) < 4 * n))
    bare = F.concat(F.lit(" "), one)
    for pattern, groups in STRIP:
        bare = F.regexp_replace(bare, pattern, "".join(f"${g}" for g in groups))
    return F.when(together | torn, "").otherwise(F.trim(bare))


def canonical_name(name: Column, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    """The name that its aliases, plurals of engineer and System for Systems share; else the name in title case."""
    titled = F.array_join(F.transform(F.split(name, " "), lambda w: F.when(F.upper(w).isin(*ABBREVIATIONS), F.upper(w)).otherwise(F.initcap(w))), " ")
    known: dict[str, str] = {}
    for main, others in aliases.items():
        for other in (main, *others):
            known.setdefault(other.lower(), main)
    folded: dict[str, str] = {}
    for main in aliases:
        folded.setdefault(main.lower().replace("systems", "system").replace("engineers", "engineer"), main)
    fold = F.replace(F.replace(F.lower(titled), F.lit("systems"), F.lit("system")), F.lit("engineers"), F.lit("engineer"))
    look = lambda table, key: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return F.coalesce(look(known, F.lower(titled)), look(folded, fold), titled) if aliases else titled


def action(context: Column, role: Column) -> tuple[Column, Column]:
    """(action, responsibility): the first class of verbs with one in the 100 characters after the role, and what follows it.

    The responsibility ends before the next full stop or semicolon, or after 100 characters. Without a verb, `is responsible
    for` counts as performs; without that, or without the role in the context, the action is unknown and it is empty.
    """
    at = F.position(F.lower(role), F.lower(context))
    after = F.when((at > 0) & (role != ""), F.trim(F.substr(context, at + F.length(role)))).otherwise("")
    head = F.substring(after, 1, 100)
    said = F.regexp_extract_all(F.lower(head), F.lit(r"\w+"), F.lit(0))
    verb = F.try_element_at(F.array_intersect(F.array(*[F.lit(v) for v, _ in VERBS]), said), F.lit(1))
    before = F.call_function("regexp_extract", head, F.concat(F.lit(r"(?i)^(.*?\b"), verb, F.lit(r")\b")), F.lit(1))
    rest = F.trim(F.substr(after, F.length(before) + 1))
    task = F.when(F.regexp_like(rest, F.lit("[.;]")), F.regexp_extract(rest, "^[^.;]*", 0)).otherwise(F.substring(rest, 1, 100))
    done = F.trim(F.regexp_extract(after, DID, 1))
    of = F.create_map(*[F.lit(x) for pair in VERBS for x in pair])[verb]
    return F.coalesce(of, F.when(done != "", "performs").otherwise("unknown")), F.when(verb.isNotNull(), F.trim(task)).otherwise(done)


def fitting(patterns: tuple[Pattern, ...]) -> Callable[[Column], Column]:
    """A function of a text to the ranks of the patterns that it may hold; no pattern that it holds is missing."""
    needed = [p.needs() for p in patterns]

    @F.arrow_udf("array<int>")
    def fit(text: pa.Array) -> pa.Array:
        held = np.stack([pc.match_substring_regex(text, n).fill_null(False).to_numpy(zero_copy_only=False) for n in needed], axis=1)
        ends = np.concatenate([[0], held.sum(axis=1).cumsum()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held.nonzero()[1], pa.int32()))

    return fit


def found_names(paras: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """(doc_id, para_idx, sent_idx, spot, rank, part, name, context): every place where a pattern finds a name.

    A sentence ends with a full stop. `spot` is 1 at a sentence's first character and 0 at the full stop before.
    The context is the sentence, for a match that begins with the full stop before also the sentence before, for one that
    takes its own full stop also the next. A null text has no names.
    """
    cut = F.split("text", r"\.")
    stop = lambda cond: F.when(cond, ".").otherwise("")
    pieces = paras.select("doc_id", "para_idx", F.posexplode(F.transform(cut, lambda t, i: F.struct(t.alias("own"), F.when(i > 0, F.get(cut, i - 1)).alias("before"), F.get(cut, i + 1).alias("next"), (i + 2 == F.size(cut)).alias("last")))).alias("sent_idx", "s"))
    own = F.concat(F.col("s.own"), stop(F.col("s.next").isNotNull()))
    units = pieces.select("doc_id", "para_idx", "sent_idx", "s.before", own.alias("own"), F.concat("s.next", stop(~F.col("s.last"))).alias("next"), F.concat(stop(F.col("sent_idx") > 0), own).alias("unit"))
    which = units.where(F.regexp_like("unit", F.lit("[A-Za-z]"))).withColumn("fits", fitting(patterns)(F.col("unit")))

    def scan(rank: int, p: Pattern) -> Column:
        group = lambda g: F.regexp_extract_all("unit", F.lit(p.regex()), F.lit(g))
        parts = {"hits": group(0), "one": group(2), "two": group(3) if p.both else F.lit(None).cast("array<string>"), "gaps": F.split("unit", p.regex(), -1)}
        found = F.struct(F.lit(rank).alias("rank"), F.lit(p.begins_at_end()).alias("early"), F.lit(p.takes_the_stop()).alias("late"), *[c.alias(n) for n, c in parts.items()])
        return F.when(F.array_contains("fits", rank), found)

    scanned = which.select("*", F.inline(F.filter(F.array(*[scan(i, p) for i, p in enumerate(patterns)]), lambda s: s.isNotNull())))
    each = scanned.select("*", F.posexplode("hits").alias("i", "hit"))
    joined = lambda parts, n: F.length(F.array_join(F.slice(parts, F.lit(1), n), ""))
    early = F.col("early") & F.startswith("hit", F.lit("."))
    context = F.concat(F.when(early, F.concat("before", F.lit("."))).otherwise(""), "own", F.when(F.col("late"), F.coalesce("next", F.lit(""))).otherwise(""))
    first, second = F.get("one", F.col("i")), F.get("two", F.col("i"))
    return each.select(
        "doc_id", "para_idx", "sent_idx", (joined("gaps", F.col("i") + 1) + joined("hits", F.col("i")) + 1 - (F.col("sent_idx") > 0).cast("int")).alias("spot"), "rank",
        F.trim(F.regexp_replace(context, r"\s+", " ")).alias("context"), F.posexplode(F.when(F.col("two").isNotNull(), F.array(first, second)).otherwise(F.array(first))).alias("part", "name"),
    )


def role_mentions(paras: DataFrame, known: DataFrame, none: DataFrame, never: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """(doc_id, para_idx, sent_idx, spot, role, name, pattern, confidence, kind, action, responsibility, context).

    paras: (doc_id, para_idx, text); the lists are those of `valid_role_names`. Every distinct name is cleaned, judged and put
    under its role once. Of the names found at one place for one role, the first pattern's stays. Names that occur very often
    are joined by broadcast.
    """
    found = stored(found_names(paras, patterns).withColumnRenamed("name", "said"))
    counted = stored(found.groupBy("said").agg(F.count("*").alias("often")))  # stored, or the cleaning below would go to every place
    often = stored(counted.withColumn("name", candidate(F.col("said"))).where("name <> ''").withColumn("low", F.lower("name")))
    judged = valid_role_names(often.select(F.col("low").alias("name")), known, none, never).where("valid")
    known_names = stored(often.join(judged.select(F.col("name").alias("low"), "confidence", "kind"), "low").drop("low").withColumn("role", canonical_name(F.col("name"), aliases)))
    roles = with_hubs(found, known_names, ["said"], "often", found.count())
    rest = F.struct("name", "rank", "confidence", "kind", "context")
    first = roles.groupBy("doc_id", "para_idx", "sent_idx", "spot", "role").agg(F.min_by(rest, F.struct("rank", "part")).alias("m")).select("doc_id", "para_idx", "sent_idx", "spot", "role", "m.*")
    act, task = action(F.col("context"), F.col("name"))
    label = F.element_at(F.array(*[F.lit(p.name) for p in patterns]), F.col("rank") + 1)
    return first.select("doc_id", "para_idx", "sent_idx", "spot", "role", "name", label.alias("pattern"), "confidence", "kind", act.alias("action"), task.alias("responsibility"), "context")


def role_document_counts(mentions: DataFrame) -> DataFrame:
    """(role, doc_id, mentions, actions): the matrix of roles and documents in long form, without deliverables."""
    return mentions.where("kind <> 'deliverable'").groupBy("role", "doc_id").agg(F.count("*").alias("mentions"), F.countDistinct("action").alias("actions"))
