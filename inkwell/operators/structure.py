"""Checks on the structure and conventions of documents: lists, headings, references, acronyms, style, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import share

LIST_ITEM = r"^\s*(\d+)([.)])\s+"
NUMBERED_LINE = r"^(\d+(?:\.\d+)*)\s+(.+)$"
#: Phrases that fill and words that weaken a paragraph (fixed values).
FILLERS = (
    "it is important to note that", "it is worth noting that", "it should be mentioned that", "it is clear that", "it is obvious that", "as we have seen",
    "as mentioned above", "as previously stated", "as we discussed", "in fact", "in reality", "in conclusion", "to summarize", "in summary", "in a nutshell",
    "it goes without saying that", "needless to say", "generally speaking", "more or less", "to some extent", "all in all", "by and large", "for the most part", "on the whole",
)
WEAK_WORDS = ("very", "quite", "rather", "somewhat", "really", "basically", "essentially", "actually", "apparently", "supposedly", "arguably", "virtually", "allegedly")
#: Double negatives, negations of unclear scope, words that negate, and terms that matter for safety (fixed values).
_UN = r"(?:un\w+|in\w+|im\w+|ir\w+|il\w+|dis\w+|non\w+)"
DOUBLE_NEGATIVES = (rf"\bnot\s+{_UN}", rf"\bno\s+{_UN}", rf"\bnever\s+{_UN}", rf"\bcan'?t\s+{_UN}", r"\bnot\s+\w+\s+not\b", r"\bno\s+\w+\s+no\b", r"\bnot\s+without\b", r"\bnone\s+\w+\s+not\b")
UNCLEAR_SCOPE = (r"\b(?:shall|must|will)\s+not\s+\w+\s+(?:and|or)\s+\w+", r"\b(?:not|no)\s+(?:all|every|each|any)\b", r"\b(?:shall|must)\s+not\s+(?:be\s+)?(?:required|expected|necessary)\s+to\b")
NEGATIONS = ("not", "no", "never", "neither", "nor", "none", "nowhere", "nothing", "nobody", "hardly", "scarcely", "barely", "without", "n't", "cannot", "can't", "won't", "wouldn't", "shouldn't", "couldn't", "mustn't", "doesn't", "don't", "didn't", "isn't", "aren't", "wasn't", "weren't", "hasn't", "haven't", "hadn't")
SAFETY_TERMS = ("fail", "failure", "hazard", "hazardous", "danger", "dangerous", "risk", "unsafe", "malfunction", "error", "fault", "defect", "damage", "loss", "injury", "harm", "collision", "crash", "overpressure", "overload", "overheat", "explosion", "fire", "leak", "rupture", "fracture", "fatigue", "corrosion", "contamination", "toxic", "lethal", "critical")
#: Words that mark a document's type (fixed values); of equal counts the first type wins.
TYPE_WORDS = (
    ("requirements", ("shall", "requirement", "specification", "traceability", "compliance")),
    ("design", ("architecture", "design", "interface", "component", "module", "diagram")),
    ("test", ("test case", "test procedure", "verification", "validation", "pass/fail")),
    ("plan", ("schedule", "milestone", "resource", "risk", "budget", "objective")),
    ("report", ("analysis", "findings", "conclusion", "recommendation", "summary")),
    ("procedure", ("step", "procedure", "instruction", "process", "workflow")),
)
#: Mistyped mail domains and what they stand for (fixed values).
MAIL_TYPOS = (("gmial.com", "gmail.com"), ("gmai.com", "gmail.com"), ("gamil.com", "gmail.com"), ("gnail.com", "gmail.com"), ("hotmial.com", "hotmail.com"), ("hotmal.com", "hotmail.com"), ("homail.com", "hotmail.com"), ("outlok.com", "outlook.com"), ("outloo.com", "outlook.com"), ("yahooo.com", "yahoo.com"), ("yaho.com", "yahoo.com"))
MAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
PASSIVE = r"(?i)\b(?:am|is|are|was|were|be|been|being)\s+(\w+(?:ed|en))\b"


def list_sequence_issues(lines: DataFrame) -> DataFrame:
    """(doc_id, para_idx, number, issue): numbered items that do not start at 1, repeat, skip or step back.

    A new list begins after a gap of more than two lines, with another delimiter, or after a line of over 100 characters.
    """
    is_item = F.regexp_like("text", F.lit(LIST_ITEM))
    doc = Window.partitionBy("doc_id").orderBy("para_idx")
    long = F.count_if(~is_item & (F.length(F.trim("text")) > 100)).over(doc.rowsBetween(Window.unboundedPreceding, 0))
    items = lines.withColumn("long", long).where(is_item).select("doc_id", "para_idx", "long", F.regexp_extract("text", LIST_ITEM, 1).cast("int").alias("number"), F.regexp_extract("text", LIST_ITEM, 2).alias("mark"))
    was = lambda c: F.lag(c).over(doc)
    new = was("para_idx").isNull() | (F.col("para_idx") > was("para_idx") + 2) | (F.col("mark") != was("mark")) | (F.col("long") > was("long"))
    lists = items.withColumn("new", new).withColumn("before", was("number")).withColumn("list", F.count_if("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("doc_id", "list").orderBy("para_idx"))
    n = F.col("number")
    issue = F.when(F.col("new"), F.when(n != 1, "start")).when(n == F.col("before"), "duplicate").when(n < F.col("place"), F.when(n != 1, "order")).when(n > F.col("place") + 1, "gap")
    return lists.withColumn("place", place).withColumn("issue", issue).where("issue is not null").select("doc_id", "para_idx", "number", "issue")


def heading_issues(headings: DataFrame) -> DataFrame:
    """(doc_id, issue, at): skipped levels, repeated headings and mixed numbering; headings: (doc_id, para_idx, number, level, title)."""
    doc = Window.partitionBy("doc_id").orderBy("para_idx")
    same = Window.partitionBy("doc_id", "level", F.trim(F.lower("title"))).orderBy("para_idx")
    style = F.when(F.regexp_like("number", F.lit(r"^\d+$")), "plain").when(F.regexp_like("number", F.lit(r"^\d+(\.\d+)+$")), "dotted").otherwise("other")
    h = headings.withColumn("skip", F.col("level") > F.lag("level", 1, 0).over(doc) + 1).withColumn("again", F.row_number().over(same) > 1)
    lines = h.select("doc_id", F.explode(F.filter(F.array(F.when(F.col("skip"), F.struct(F.lit("skipped_level").alias("issue"), F.col("para_idx").alias("at"))), F.when(F.col("again"), F.struct(F.lit("duplicate").alias("issue"), F.col("para_idx").alias("at")))), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")
    mixed = headings.groupBy("doc_id", "level").agg(F.countDistinct(style).alias("styles")).where("styles > 1").select("doc_id", F.lit("mixed_numbering").alias("issue"), F.col("level").alias("at"))
    return lines.unionByName(mixed)


def empty_sections(lines: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, para_idx, words, severity): numbered headings with fewer words than `least` before the next one."""
    heads = F.regexp_like(F.trim("text"), F.lit(NUMBERED_LINE))
    so_far = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    named = lines.withColumn("heads", heads).withColumn("section", F.count_if(heads).over(so_far)).where("section > 0")
    per = named.groupBy("doc_id", "section").agg(F.min("para_idx").alias("para_idx"), F.sum(F.when(F.col("heads"), 0).otherwise(words)).alias("words"))
    return per.where(F.col("words") < least).select("doc_id", "para_idx", "words", F.when(F.col("words") == 0, "Medium").otherwise("Low").alias("severity"))


def orphan_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, para_idx, number): the only direct child that a numbered heading has after it."""
    head = lines.where(F.regexp_like(F.trim("text"), F.lit(NUMBERED_LINE))).select("doc_id", "para_idx", F.regexp_extract(F.trim("text"), NUMBERED_LINE, 1).alias("number"))
    child = head.select("doc_id", F.col("para_idx").alias("at"), F.col("number").alias("child"), F.regexp_replace("number", r"\.?\d+$", "").alias("number")).where("number <> ''")
    per = head.join(child, ["doc_id", "number"]).where("at > para_idx").groupBy("doc_id", "para_idx").agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("child").alias("child"))
    return per.where("n = 1").select("doc_id", F.col("at").alias("para_idx"), F.col("child").alias("number")).distinct()


def toc_mismatches(toc: DataFrame, headings: DataFrame) -> DataFrame:
    """Entries (doc_id, entry) of a table of contents that no heading (doc_id, title) of the document equals or contains, or is contained in."""
    low = lambda c: F.trim(F.lower(c))
    own = headings.select("doc_id", low(F.col("title")).alias("title")).where("title <> ''").distinct()
    open_ = toc.withColumn("key", low(F.col("entry"))).join(own.withColumnRenamed("title", "key"), ["doc_id", "key"], "left_anti")
    near = (open_["doc_id"] == own["doc_id"]) & (F.contains("key", F.col("title")) | F.contains("title", F.col("key")))
    return open_.join(own, near, "left_anti").drop("key")


def acronym_order_issues(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(doc_id, acronym, issue): used before its definition, used twice or more without one, defined and not used again,
    defined more than once; both: (doc_id, acronym, para_idx, pos), and a definition is a use as well."""
    at = F.struct("para_idx", "pos")
    d = defs.groupBy("doc_id", "acronym").agg(F.min(at).alias("defined"), F.count("*").alias("definitions"))
    u = uses.groupBy("doc_id", "acronym").agg(F.min(at).alias("used"), F.count("*").alias("uses"))
    j = d.join(u, ["doc_id", "acronym"], "full")
    found = F.array(F.when(F.col("used") < F.col("defined"), "before_definition"), F.when(F.col("defined").isNull() & (F.col("uses") >= 2), "never_defined"), F.when(F.col("defined").isNotNull() & (F.coalesce("uses", F.lit(0)) <= 1), "never_used"), F.when(F.col("definitions") > 1, "defined_again"))
    return j.select("doc_id", "acronym", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def used_before_defined(terms: DataFrame) -> DataFrame:
    """(doc_id, term, used, defined) where the first use comes before the definition; terms: (doc_id, term, kind, pos)."""
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("pos")))
    return terms.groupBy("doc_id", "term").agg(first("use").alias("used"), first("definition").alias("defined")).where("used < defined")


def reference_statistics(refs: DataFrame, items: DataFrame) -> DataFrame:
    """(type, references, items, broken, unreferenced); refs and items: (doc_id, type, number)."""
    key = ["doc_id", "type", "number"]
    r = refs.groupBy(*key).agg(F.count("*").alias("r"))
    i = items.groupBy(*key).agg(F.count("*").alias("i"))
    j = r.join(i, key, "full").fillna(0, ["r", "i"])
    return j.groupBy("type").agg(F.sum("r").alias("references"), F.sum("i").alias("items"), F.sum(F.when(F.col("i") == 0, F.col("r")).otherwise(0)).alias("broken"), F.sum(F.when(F.col("r") == 0, F.col("i")).otherwise(0)).alias("unreferenced"))


def health_score(docs: DataFrame) -> DataFrame:
    """(doc_id, total, grade) of (doc_id, weighted, fk_grade, has_toc, headings, sections, tables, figures, words, paragraphs)."""
    tier = lambda c, *steps: reduce(lambda out, s: out.when(F.col(c) >= s[0], s[1]), steps[1:], F.when(F.col(c) >= steps[0][0], steps[0][1])).otherwise(0)
    fk = F.col("fk_grade")
    issues = 50 - F.least(F.lit(50.0), F.when(F.col("weighted") > 0, F.log1p(F.col("weighted") / 20) * 25).otherwise(0.0))
    readable = F.when(fk > 20, 5).when(fk > 18, 8).when(fk > 16, 12).when(fk >= 10, 15).otherwise(12)
    structure = F.least(F.lit(20), F.when(F.col("has_toc"), 7).otherwise(0) + tier("headings", (5, 7), (2, 4)) + tier("sections", (3, 6), (1, 3)))
    complete = F.least(F.lit(15), tier("tables", (1, 3)) + tier("figures", (1, 3)) + tier("words", (1001, 5), (301, 3)) + tier("paragraphs", (6, 4), (3, 2)))
    total = F.round(issues + readable + structure + complete, 6)
    grade = F.when(total >= 90, "A").when(total >= 80, "B").when(total >= 65, "C").when(total >= 50, "D").otherwise("F")
    return docs.select("doc_id", F.round(total, 1).alias("total"), grade.alias("grade"))


def document_type(paras: DataFrame, first: int = 50) -> DataFrame:
    """(doc_id, type, confidence, indicators): the type most of whose words occur in the first paragraphs; 'general' without any."""
    parts = F.array_sort(F.collect_list(F.when(F.col("para_idx") < first, F.struct("para_idx", "text"))))
    text = F.lower(F.array_join(F.transform(parts, lambda x: x["text"]), " "))
    n = lambda words: reduce(lambda a, b: a + b, [F.contains("t", F.lit(w)).cast("int") for w in words])
    best = F.array_max(F.array(*[F.struct(n(words).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("type")) for i, (name, words) in enumerate(TYPE_WORDS)]))
    found = paras.groupBy("doc_id").agg(text.alias("t")).withColumn("best", best)
    return found.select("doc_id", F.when(F.col("best.n") > 0, F.col("best.type")).otherwise("general").alias("type"), F.round(F.least(F.lit(1.0), F.col("best.n") / 3), 2).alias("confidence"), F.col("best.n").alias("indicators"))


def filler_density(paras: DataFrame) -> DataFrame:
    """(doc_id, para_idx, fillers, weak, issue): paragraphs with filler phrases, or with three weak words and more."""
    low = F.lower("text")
    n = lambda tests: reduce(lambda a, b: a + b, [t.cast("int") for t in tests])
    counted = paras.select("doc_id", "para_idx", n([F.contains(low, F.lit(p)) for p in FILLERS]).alias("fillers"), n([F.regexp_like(low, F.lit(rf"\b{w}\b")) for w in WEAK_WORDS]).alias("weak"))
    found = F.array(F.when(F.col("fillers") >= 2, "padded").when(F.col("fillers") == 1, "filler"), F.when(F.col("weak") >= 3, "weak_words"))
    return counted.select("*", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def negation_issues(sents: DataFrame, near: int = 3) -> DataFrame:
    """(doc_id, para_idx, issue, n): double negatives, negations of unclear scope, and safety terms within `near` words after a negation."""
    count = lambda patterns: reduce(lambda a, b: a + b, [F.regexp_count("text", F.lit("(?i)" + p)) for p in patterns])
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0))
    negated = lambda i: F.exists(F.slice(F.col("w"), F.greatest(i + 1 - near, F.lit(1)), F.least(F.lit(near), i)), lambda x: x.isin(*NEGATIONS))
    safety = F.size(F.filter("w", lambda x, i: x.isin(*SAFETY_TERMS) & negated(i)))
    issues = F.array(F.struct(F.lit("double_negative").alias("issue"), count(DOUBLE_NEGATIVES).alias("n")), F.struct(F.lit("unclear_scope").alias("issue"), count(UNCLEAR_SCOPE).alias("n")), F.struct(F.lit("negated_safety_term").alias("issue"), safety.alias("n")))
    return sents.withColumn("w", w).select("doc_id", "para_idx", F.inline(issues)).where("n > 0")


def passive_voice(paras: DataFrame, adjectives: tuple[str, ...] = (), most: float = 0.3) -> DataFrame:
    """(doc_id, para_idx, passives, sentences, ratio): paragraphs whose share of passives to sentences passes `most`; participles
    that are used as adjectives do not count."""
    hits = F.filter(F.regexp_extract_all("text", F.lit(PASSIVE), F.lit(1)), lambda x: ~F.lower(x).isin(*adjectives) if adjectives else F.lit(True))
    ends = F.greatest(F.regexp_count("text", F.lit(r"[.!?]+")), F.lit(1))
    counted = paras.select("doc_id", "para_idx", F.size(hits).alias("passives"), ends.alias("sentences")).where("passives > 0")
    return counted.withColumn("ratio", F.round(share(F.col("passives"), F.col("sentences")), 6)).where(F.col("ratio") > most)


def spelling_mix(docs: DataFrame, pairs: tuple[tuple[str, str], ...], examples: int = 5) -> DataFrame:
    """(doc_id, uk, us, majority, minority): documents with British and American spellings of pairs, and examples of the fewer."""
    side = F.create_map(*[F.lit(x) for uk, us in pairs for x in (uk, "uk", us, "us")])
    words = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[a-zA-Z]+"), F.lit(0)), F.lower), lambda w: side[w].isNotNull())
    split = docs.select("doc_id", words.alias("w")).select("doc_id", F.filter("w", lambda w: side[w] == "uk").alias("uk"), F.filter("w", lambda w: side[w] == "us").alias("us")).where("size(uk) > 0 AND size(us) > 0")
    more = F.size("uk") >= F.size("us")
    return split.select("doc_id", F.size("uk").alias("uk"), F.size("us").alias("us"), F.when(more, "uk").otherwise("us").alias("majority"), F.slice(F.array_sort(F.array_distinct(F.when(more, F.col("us")).otherwise(F.col("uk")))), 1, examples).alias("minority"))


def convention_mix(lines: DataFrame) -> DataFrame:
    """(doc_id, convention, first, second): conventions of which a document uses both forms, and how often each."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    forms = (
        ("contractions", n(r"(?i)\b\w+(?:n't|'re|'ve|'ll)\b"), n(r"(?i)\b(?:is|are|was|were|do|does|did|have|has|had|will|would|can|could|should) not\b")),
        ("serial_comma", n(r"(?i)\w+, \w+, (?:and|or) \w+"), n(r"(?i)\w+, \w+ (?:and|or) \w+")),
        ("directives", n(r"(?i)\bshall\b"), n(r"(?i)\b(?:must|will)\b")),
        ("heading_case", n(r"^\d+(?:\.\d+)*\s+(?:[A-Z][\w-]*\s*)+$"), n(r"^\d+(?:\.\d+)*\s+[A-Z][\w-]*(?:\s+[a-z].*)+$")),
    )
    one = F.array(*[F.struct(F.lit(name).alias("convention"), a.alias("a"), b.alias("b")) for name, a, b in forms])
    return lines.select("doc_id", F.inline(one)).groupBy("doc_id", "convention").agg(F.sum("a").alias("first"), F.sum("b").alias("second")).where("first > 0 AND second > 0")


def name_case(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(doc_id, written, name, n): known names of one word in another case than their own."""
    own = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[a-zA-Z]+"), F.lit(0))).alias("written"))
    return words.withColumn("name", own[F.lower("written")]).where("name is not null AND name <> written").groupBy("doc_id", "written", "name").agg(F.count("*").alias("n"))


def mailto_issue(link: Column) -> Column:
    """What is wrong with a mailto link: not one, no address, a bad form, a mistyped domain, no top-level domain; else null."""
    part = F.split(F.substring(link, 8, 1_000_000), r"\?")[0]
    mails = F.filter(F.transform(F.split(F.url_decode(part), ","), lambda m: F.trim(m)), lambda m: m != "")
    typo = F.create_map(*[F.lit(x) for pair in MAIL_TYPOS for x in pair])
    domain = lambda m: F.lower(F.substring_index(m, "@", -1))
    of = lambda m: F.when(~F.regexp_like(m, F.lit(MAIL)), F.concat(F.lit("bad form: "), m)).when(typo[domain(m)].isNotNull(), F.concat(F.lit("meant: "), typo[domain(m)])).when(~F.contains(domain(m), F.lit(".")), F.lit("no top-level domain"))
    first = F.element_at(F.concat(F.filter(F.transform(mails, of), lambda x: x.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
    return F.when(~F.startswith(F.lower(link), F.lit("mailto:")), "not a mail link").when(F.size(mails) == 0, "no address").otherwise(first)


def tense_profile(sents: DataFrame, markers: tuple[str, ...] = ("will", "shall", "going to")) -> DataFrame:
    """(doc_id, past, present, future, dominant, inconsistent): verb-like words by tense, and sentences of more than one.

    A sentence with a marker is of the future; words in -ed are past, in -s after another word, or forms of be, present.
    """
    low = F.lower("text")
    count = lambda p: F.regexp_count(low, F.lit(p))
    future = F.greatest(*[F.contains(low, F.lit(m)) for m in markers], F.lit(False)).cast("int")
    past, present = count(r"\b(?:was|were|had|did|[a-z]{2,}ed)\b"), count(r"\b(?:is|are|am|has|have|do|does)\b")
    t = sents.select("doc_id", past.alias("past"), present.alias("present"), future.alias("future"))
    mixed = (F.col("past") > 0).cast("int") + (F.col("present") > 0).cast("int") + F.col("future") > 1
    per = t.groupBy("doc_id").agg(F.sum("past").alias("past"), F.sum("present").alias("present"), F.sum("future").alias("future"), F.count_if(mixed).alias("inconsistent"))
    top = F.greatest("past", "present", "future")
    return per.withColumn("dominant", F.when(top == 0, F.lit(None)).when(F.col("past") == top, "past").when(F.col("present") == top, "present").otherwise("future"))


#: Verbs whose form does not show their tense, and marks of the future (fixed values).
PAST_VERBS = (
    "was", "were", "had", "did", "went", "came", "saw", "made", "said", "took", "got", "gave", "found", "thought", "told", "became", "left",
    "felt", "brought", "began", "kept", "held", "wrote", "stood", "heard", "let", "meant", "set", "met", "ran", "paid", "sat", "spoke", "lay",
    "led", "read", "grew", "lost", "knew", "sent", "built", "fell", "cut", "put",
)
PRESENT_VERBS = ("is", "am", "are", "has", "does", "goes", "comes", "sees", "makes", "says", "takes", "gets", "gives")
FUTURE_MARKS = ("will", "shall", "'ll", "going to")
NO_VERBS = ("the", "a", "an", "is", "are", "to")


def word_tense(word: Column) -> Column:
    """past, present or null of a lower-case word: a known verb's, else by -ed (over 3 letters), -s (over 2, but not -ss, -us, -is) or -ing (over 4)."""
    known = F.when(word.isin(*PAST_VERBS), "past").when(word.isin(*PRESENT_VERBS), "present")
    n = F.length(word)
    by_end = F.when(word.endswith("ed") & (n > 3), "past").when(word.endswith("s") & (n > 2) & ~F.regexp_like(word, F.lit("(ss|us|is)$")), "present").when(word.endswith("ing") & (n > 4), "present")
    return F.coalesce(known, by_end)


def tenses(docs: DataFrame) -> DataFrame:
    """(doc_id, past, present, future, verbs, dominant, inconsistent) from every verb-like word of every sentence.

    A sentence with a mark of the future counts once for it; words of NO_VERBS and single letters have no tense. A sentence of
    more than one tense is inconsistent. The dominant tense is the most frequent, of equals past before present before
    future, and `unknown` without any. A document without sentences, or a null text, has zeros.
    """
    low = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[.!?]+"), lambda s: F.regexp_like(s, F.lit(r"\S")))
    tense = lambda w: F.when((F.length(w) >= 2) & ~w.isin(*NO_VERBS), word_tense(w))
    future = lambda s: F.greatest(*[F.contains(s, F.lit(m)) for m in FUTURE_MARKS])
    of = lambda s: F.struct(F.transform(F.regexp_extract_all(s, F.lit(r"\b[a-z]+\b"), F.lit(0)), tense).alias("t"), future(s).cast("int").alias("future"))
    each = docs.select("doc_id", F.explode_outer(F.transform(low, of)).alias("s"))
    count = lambda t: F.coalesce(F.size(F.filter("s.t", lambda x: x == t)), F.lit(0))
    per_sentence = each.select("doc_id", count("past").alias("past"), count("present").alias("present"), F.coalesce("s.future", F.lit(0)).alias("future"))
    mixed = (F.col("past") > 0).cast("int") + (F.col("present") > 0).cast("int") + F.col("future") > 1
    per = per_sentence.groupBy("doc_id").agg(F.sum("past").alias("past"), F.sum("present").alias("present"), F.sum("future").alias("future"), F.count_if(mixed).alias("inconsistent"))
    most = F.greatest("past", "present", "future")
    dominant = F.when(most == 0, "unknown").when(F.col("past") == most, "past").when(F.col("present") == most, "present").otherwise("future")
    return per.select("doc_id", "past", "present", "future", (F.col("past") + F.col("present") + F.col("future")).alias("verbs"), dominant.alias("dominant"), "inconsistent")
