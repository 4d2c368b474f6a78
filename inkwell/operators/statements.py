"""Statements and requirements: directives, sections, extraction, their rules, and what is counted on them.

Lines and statements keep (doc_id, para_idx) of where they stand; a document's lines are ordered by para_idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.linear import holding
from inkwell.operators.text import sentences

#: Broken encodings and typographic characters with their plain forms, longer ones first (fixed values).
PLAIN = (
    ("â\u0080\u0099", "'"), ("â\u0080\u0098", "'"), ("â\u0080\u009c", '"'), ("â\u0080\u009d", '"'),
    ("â\u0080\u0094", "-"), ("â\u0080\u0093", "-"), ("â\u0080¦", "..."), ("â\u0080¢", "-"),
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã±", "ñ"), (" ", " "), ("’", "'"),
    ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("•", "-"),
    ("·", "-"), ("�", " "),
)
#: Phrases that direct, with the directive they count as, then single words, in the order they are tried (fixed values).
DIRECTIVE_PHRASES = (("is responsible for", "responsible"), ("are responsible for", "responsible"), ("is accountable for", "accountable"), ("are accountable for", "accountable"), ("is required to", "required"), ("are required to", "required"), ("needs to", "should"), ("need to", "should"), ("has to", "must"), ("have to", "must"), ("it is the responsibility of", "responsible"))
DIRECTIVE_WORDS = ("shall", "must", "will", "should", "may", "ensure", "verify", "confirm")
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+([A-Z].*)$"
#: Modal verbs of requirements (fixed values).
MODALS = ("shall", "must", "will", "should", "may", "can", "need", "could", "might", "would")
MODAL = r"(?i)\b(" + "|".join(MODALS) + r")\b"
#: Forms of a requirement's id, in the order they are tried (fixed values).
REQUIREMENT_IDS = (r"\b([A-Z]{2,5}[-_]\d{3,6})\b", r"\b(REQ[-_]\d{3,6})\b", r"\b([A-Z]{2,5}\.\d{1,3}(?:\.\d{1,3})*)\b", r"\b(\d{1,2}\.\d{1,2}(?:\.\d{1,2})*)\b", r"\[([A-Z]{2,5}[-_]\d{3,6})\]")
PARTS = r"(?is)^(.+?)\s+(?:" + "|".join(MODALS) + r")\s+(\w+)\s+(.+?)(?:\s+(?:when|if|unless|after|before)\s+(.+?))?[.!?]?$"
SVO = r"(?is)^(.*?)\s+(?:shall|must|will|should)\s+(\w+)\s+(.*?)(?:\.|$)"
#: Terms that leave a requirement open, and terms that make it vague (fixed values).
ESCAPES = ("tbd", "tbs", "tbr", "tbc", "tbdel", "to be determined", "to be supplied", "to be resolved", "to be confirmed", "to be defined", "to be specified", "not yet defined", "not yet determined", "pending", "[tbd]", "[tbs]", "[tbr]", "(tbd)", "(tbs)", "(tbr)", "<tbd>", "<tbs>", "<tbr>")
AMBIGUOUS = (
    "appropriate", "adequate", "sufficient", "reasonable", "suitable", "acceptable", "enough", "excessive", "ample", "plenty",
    "timely", "promptly", "quickly", "rapidly", "soon", "immediate", "without delay", "as soon as possible", "asap", "periodically",
    "frequently", "occasionally", "regularly", "normally", "usually", "as required", "if necessary", "as needed", "when necessary",
    "as appropriate", "if applicable", "where applicable", "as applicable", "if required", "when required", "unless otherwise specified",
    "etc", "etc.", "and so on", "and/or", "and the like", "such as", "for example", "e.g.", "i.e.", "including but not limited to",
    "minimize", "maximize", "optimize", "improve", "enhance", "user-friendly", "easy to use", "simple", "straightforward", "flexible",
    "robust", "reliable", "efficient", "effective", "some", "several", "various", "numerous", "few", "many", "most", "all applicable",
    "relevant", "fast", "slow", "high", "low", "large", "small", "good", "bad", "acceptable performance", "satisfactory", "adequate performance",
)
#: What makes a requirement measurable, or says how it is verified (fixed values). A number alone is enough as well.
VERIFIED = r"(?i)\b(verified|validated|tested|measured|demonstrated|inspected|analyzed)\b"
NUMBER = r"\b\d+(?:\.\d+)?\b|\d+(?:\.\d+)?\s*(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?|ms|msec|sec|min|hrs?|meters?|m|cm|mm|km|feet|ft|inches?|in|kg|g|mg|lbs?|pounds?|oz|ounces?|[mgtk]b|bytes?|bits?|[kmg]?hz|watts?|[km]?w|volts?|v|amps?|a|percent|%|times?|iterations?|cycles?|occurrences?)"


def clean_text(text: Column) -> Column:
    for bad, good in PLAIN:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def directive(text: Column) -> Column:
    """The directive of a text, '' without one: phrases are tried first, then words."""

    def led(low: Column) -> Column:
        phrases = [F.when(F.contains(low, F.lit(p)), d) for p, d in DIRECTIVE_PHRASES]
        words = [F.when(F.regexp_like(low, F.lit(rf"\b{w}\b")), w) for w in DIRECTIVE_WORDS]
        return F.coalesce(*phrases, F.when(F.regexp_like(low, F.lit("|".join(DIRECTIVE_WORDS))), F.coalesce(*words)), F.lit(""))

    return F.get(F.transform(F.array(F.lower(text)), led), F.lit(0))  # lower case once, not once for each trial


def in_sections(lines: DataFrame) -> DataFrame:
    """Lines after a numbered heading, with `section` (how many headings so far), its `number`, and `is_heading`."""
    named = lines.withColumn("is_heading", F.regexp_like("text", F.lit(NUMBERED)))
    heads = F.col("is_heading")
    so_far = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    number = F.last(F.when(heads, F.regexp_extract("text", NUMBERED, 1)), ignorenulls=True).over(so_far)
    return named.withColumn("section", F.count_if(heads).over(so_far)).withColumn("number", number).where("section > 0")


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section, number, title, level, lines, content): numbered sections, with the lines up to the next heading."""
    line = F.when(~F.col("is_heading"), F.struct("para_idx", "text"))
    title = F.max(F.when(F.col("is_heading"), F.trim(F.regexp_extract("text", NUMBERED, 2))))
    per = in_sections(lines).groupBy("doc_id", "section").agg(F.first("number").alias("number"), title.alias("title"), F.array_sort(F.collect_list(line)).alias("l"))
    level = F.least(F.lit(6), F.size(F.split("number", r"\.")))
    return per.select("doc_id", "section", "number", "title", level.alias("level"), F.size("l").alias("lines"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))


def statements(lines: DataFrame, shortest: int = 20) -> DataFrame:
    """(doc_id, number, directive, title, statement): directing sentences of sections, numbered within the section.

    Of sentences with the same first 100 characters in a document, without regard to case, the first stays.
    """
    said = sentences(in_sections(lines).where(~F.col("is_heading")).select("doc_id", "section", "number", "para_idx", "text"))
    led = F.filter(F.array(directive(F.col("sentence"))), lambda d: d != "")  # as rows, or the filter would work it out again
    said = said.where(F.length("sentence") >= shortest).select("*", F.explode(led).alias("directive"))
    order = ["para_idx", "sent_idx"]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    once = said.withColumn("place", place("doc_id", F.lower(F.substring("sentence", 1, 100)))).where("place = 1")
    k, of = place("doc_id", "section"), place("doc_id", "section", "directive")
    return once.select("doc_id", F.concat_ws(".", "number", k.cast("string")).alias("number"), "directive", F.concat(F.initcap("directive"), F.lit(" statement "), of.cast("string")).alias("title"), F.col("sentence").alias("statement"))


def requirements(lines: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text, modal, req_id, subject, action, object, condition) of every line with a modal verb."""
    some = lambda c: F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))  # noqa: E731  # null if empty; worked out once
    begins = "(?=[" + "".join(sorted({m[0] for m in MODALS})) + "])"  # the letter is tried before the word
    modal = some(F.lower(F.regexp_extract("text", MODAL.replace(r"\b(", begins + r"\b(", 1), 1)))
    found = lines.select("doc_id", "para_idx", "text", F.explode(F.filter(F.array(modal), lambda x: x.isNotNull())).alias("modal"))
    begin = lambda p: p.replace(r"\b([A-Z]", r"(?=[A-Z])\b([A-Z]").replace(r"\b(\d", r"(?=\d)\b(\d")
    req_id = F.when(F.regexp_like("text", F.lit(r"\d")), F.coalesce(*[some(F.regexp_extract("text", begin(p), 1)) for p in REQUIREMENT_IDS]))
    part = lambda n: some(F.trim(F.regexp_extract("text", PARTS, n)))
    return found.select("doc_id", "para_idx", "text", "modal", req_id.alias("req_id"), part(1).alias("subject"), part(2).alias("action"), part(3).alias("object"), part(4).alias("condition"))


def subject_verb_object(lines: DataFrame) -> DataFrame:
    """(doc_id, para_idx, subject, verb, object) of directing lines; articles and a closing when-clause go."""
    part = lambda n: F.trim(F.regexp_extract("text", SVO, n))
    found = lines.where(F.regexp_like("text", F.lit(SVO)))
    return found.select("doc_id", "para_idx", F.regexp_replace(part(1), r"(?i)^(?:The|A|An)\s+", "").alias("subject"), part(2).alias("verb"), F.regexp_replace(part(3), r"(?i)\s+when.*$", "").alias("object"))


def word_pattern(term: str) -> str:
    return r"\b" + "".join("\\" + c if c in ".+*?()[]{}^$|" else c for c in term) + r"\b"


def requirement_issues(reqs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, issue, severity, flagged): each requirement by the rules of good requirements."""
    text, none = F.col("text"), F.lit(None).cast("string")
    terms = [("escape_clause", "error", t, "".join("\\" + c if c in ".+*?()[]{}^$|" else c for c in t)) for t in ESCAPES] + [("ambiguous", "warning", t, word_pattern(t)) for t in AMBIGUOUS]
    both = r"(?i)\bshall\s+\w+\s+and\s+\w+\b"
    tests = (r"(?is)\b(?:shall|must|will)\b.*\b(?:shall|must|will)\b", both, f"(?i){NUMBER}|{VERIFIED}", r"(?i)\bshall\s+be\s+\w+ed\b")
    held = reqs.select("doc_id", "para_idx", "text", "modal", "subject", holding([p for *_, p in terms])(F.lower(text)).alias("terms"), holding(tests)(text).alias("tests"))
    one = lambda holds, kind, severity, flagged=none: F.when(holds, F.struct(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), flagged.alias("flagged")))
    test = lambda i: F.array_contains("tests", i)
    issues = F.array(
        one(test(0), "atomicity", "warning"),
        one(test(1), "atomicity", "info", F.regexp_extract(text, both, 0)),
        one(~test(2), "testability", "warning"),
        one(F.col("modal") == "must", "modal_inconsistency", "info", F.col("modal")),
        one(F.col("modal").isin("should", "may", "can", "could", "might"), "modal_inconsistency", "warning", F.col("modal")),
        one(F.col("subject").isNull(), "structure", "warning"),
        one(test(3), "structure", "info"),
    )
    known = F.array(*[one(F.lit(True), kind, severity, F.lit(t)) for kind, severity, t, _ in terms])
    named = F.transform("terms", lambda i: F.get(known, i))
    return held.select("doc_id", "para_idx", F.inline(F.concat(F.filter(issues, lambda i: i.isNotNull()), named)))


def requirement_statistics(reqs: DataFrame, issues: DataFrame) -> DataFrame:
    """(modal, requirements, with_id, issues, per_requirement), with a row for all (modal null)."""
    n = issues.groupBy("doc_id", "para_idx").agg(F.count("*").alias("n"))
    joined = reqs.join(n, ["doc_id", "para_idx"], "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return joined.rollup("modal").agg(F.count("*").alias("requirements"), F.count("req_id").alias("with_id"), total.alias("issues"), F.round(total / F.count("*"), 6).alias("per_requirement"))


def steps(lines: DataFrame, verbs: tuple[str, ...]) -> DataFrame:
    """(doc_id, para_idx, kind, text): bullets, numbered steps and lines that begin with an action verb; a line `then ...`
    is joined to the condition `if ...` right before it."""
    t = F.trim("text")
    kind = F.when(F.regexp_like(t, F.lit(r"^[-*•]\s+")), "bullet").when(F.regexp_like(t, F.lit(r"^\d+[.)]\s+")), "step").when(F.regexp_like(t, F.lit(r"(?i)^if\b")), "condition").when(F.regexp_like(t, F.lit(r"(?i)^then\b")), "action").when(F.regexp_like(t, F.lit(r"(?i)^(" + "|".join(verbs) + r")\b")), "verb")
    w = Window.partitionBy("doc_id").orderBy("para_idx")
    named = lines.select("doc_id", "para_idx", t.alias("text"), kind.alias("kind"))
    after = named.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_text", F.lead("text").over(w)).withColumn("before", F.lag("kind").over(w))
    pair = (F.col("kind") == "condition") & (F.coalesce("next_kind", F.lit("")) == "action")
    closed = (F.col("kind") == "action") & (F.coalesce("before", F.lit("")) == "condition")
    body = F.regexp_replace("text", r"^(?:[-*•]|\d+[.)])\s+", "")
    return after.where(F.col("kind").isNotNull() & ~closed).select("doc_id", "para_idx", F.when(pair, "if_then").otherwise(F.col("kind")).alias("kind"), F.when(pair, F.concat_ws(" ", "text", "next_text")).otherwise(body).alias("text"))


def chains(lines: DataFrame) -> DataFrame:
    """(doc_id, chain, first, lines, text): each run of condition and action lines in a row as one text."""
    holds = F.regexp_like("text", F.lit(r"(?i)^\s*(if|when|then|else|otherwise)\b"))
    w = Window.partitionBy("doc_id").orderBy("para_idx")
    begins = holds & (~F.coalesce(F.lag("holds").over(w), F.lit(False)) | F.regexp_like("text", F.lit(r"(?i)^\s*(if|when)\b")))
    runs = lines.withColumn("holds", holds).withColumn("chain", F.sum(F.when(begins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("holds")
    return runs.groupBy("doc_id", "chain").agg(F.min("para_idx").alias("first"), F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), " ").alias("text"))


def statement_flags(stmts: DataFrame) -> DataFrame:
    """Statements (description, confidence) with `flags`: what makes each doubtful."""
    d = F.trim("description")
    words = F.size(F.filter(F.split(d, r"\s+"), lambda w: w != ""))
    flags = F.array(F.when(words < 3, "fragment"), F.when(F.regexp_like(d, F.lit(r"^[\d\s.,]+$")), "only_digits"), F.when(words > 80, "too_long"), F.when(F.regexp_like(d, F.lit(r"(?i)^(table|figure|note|see|ref|page)\b")), "not_a_statement"), F.when(F.col("confidence") < 0.5, "low_confidence"))
    return stmts.withColumn("flags", F.filter(flags, lambda f: f.isNotNull()))


def find_statements(stmts: DataFrame, like: str | None = None, status: str | None = None, role: str | None = None, directives: tuple[str, ...] = (), flagged: bool | None = None) -> DataFrame:
    """Statements (description, title, number, status, role, directive[, flags]) that pass every given filter."""
    if like is not None:
        stmts = stmts.where(F.greatest(*[F.coalesce(F.ilike(F.col(c), F.lit(f"%{like}%")), F.lit(False)) for c in ("description", "title", "number")]))
    if status is not None:
        stmts = stmts.where(F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")) == status)
    if role is not None:
        stmts = stmts.where(F.lower("role") == role.lower())
    if directives:
        stmts = stmts.where(F.col("directive").isin(*directives))
    return stmts if flagged is None else stmts.where((F.size("flags") > 0) == flagged)


def review_stats(stmts: DataFrame) -> DataFrame:
    """Statements in all, reviewed, pending (no status, or so named), rejected and confirmed."""
    s = F.coalesce(F.nullif("status", F.lit("")), F.lit("pending"))
    return stmts.agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("reviewed", "pending", "rejected", "confirmed")])


def statement_trends(scans: DataFrame, stmts: DataFrame, last: int) -> DataFrame:
    """(scan_id, total, shall, must, will, should, may) of the last scans, zeros kept, oldest first."""
    newest = scans.orderBy(F.desc("scan_time"), F.desc("scan_id")).limit(last)
    joined = newest.join(stmts.select("scan_id", "directive"), "scan_id", "left")
    return joined.groupBy("scan_id", "scan_time").agg(F.count("directive").alias("total"), *[F.count_if(F.col("directive") == d).alias(d) for d in DIRECTIVE_WORDS[:5]]).orderBy("scan_time", "scan_id").drop("scan_time")


def merge_responsibilities(old: DataFrame, new: DataFrame) -> DataFrame:
    """(role, text): the old rows, and new texts that the role does not have, without regard to case and outer spaces."""
    both = old.select("role", "text", "seq", F.lit(0).alias("late")).unionByName(new.select("role", "text", "seq", F.lit(1).alias("late")))
    place = F.row_number().over(Window.partitionBy("role", F.lower(F.trim("text"))).orderBy("late", "seq"))
    return both.withColumn("place", place).where("late = 0 OR place = 1").select("role", "text")


#: Beginnings of verbs by who does them: responsible, accountable, consulted, informed, in the order they are tried (fixed values).
RACI_STEMS = (
    ("R", ("perform", "execute", "implement", "develop", "define", "lead", "ensure", "maintain", "conduct", "create", "prepare", "manage", "oversee", "verif", "valid")),
    ("A", ("approv", "authoriz", "sign", "certif", "accept")),
    ("C", ("review", "coordinat", "support", "consult", "advis", "assist", "collaborat")),
    ("I", ("receiv", "report", "monitor", "inform", "notif", "communicat", "track", "provid")),
)


def raci(stmts: DataFrame, stems: tuple[tuple[str, tuple[str, ...]], ...] = RACI_STEMS) -> DataFrame:
    """(role, R, A, C, I, main): the verbs after a modal in each role's distinct statements, by class; R without one.

    stems: (class, beginnings of verbs) in the order they are tried. Ties go to R, then A, C and I.
    """
    verb = r"(?i)\b(?:shall|must|will|should|may)\s+(\w+)"
    verbs = F.transform(F.regexp_extract_all("text", F.lit(verb), F.lit(1)), F.lower)
    said = stmts.select("role", F.trim("text").alias("text")).where("text <> ''").distinct()
    each = said.select("role", F.explode(F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit("")))).alias("verb"))
    kind = F.coalesce(*[F.when(F.regexp_like("verb", F.lit("^(" + "|".join(s) + ")")), k) for k, s in stems], F.lit("R"))
    n = each.select("role", kind.alias("kind")).groupBy("role").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in "RACI"])
    main = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate("RACI")]))["k"]
    return n.withColumn("main", main)


def export_rows(stmts: DataFrame) -> DataFrame:
    """Statements (level 1 to 6, title, description, role) as rows of a table: title and description in their level's columns."""
    cells = [F.when(F.col("level") == i, F.col(c)).otherwise("").alias(f"{c}_{i}") for i in range(1, 7) for c in ("title", "description")]
    return stmts.select("doc_id", "para_idx", *cells, F.coalesce("role", F.lit("")).alias("role"))

