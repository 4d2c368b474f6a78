"""Summaries of batches, fixes, roles, links, vendors and comparisons: aggregations and joins over result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.metrics import top_k

#: Indirect rates: words that name them, and their typical range in percent of direct labour (fixed values).
RATES = (
    ("fringe", r"(?i)\bfringe\b|\bbenefits?\b|\bFBR\b", 25, 45),
    ("overhead", r"(?i)\boverhead\b|\bOH\b|\bOHR\b|\bindirect\s*cost\b", 40, 120),
    ("ga", r"(?i)\bG\s*&\s*A\b|\bgeneral\s*(?:and|&)\s*admin|\bGA\b", 10, 25),
    ("fee", r"(?i)\b(?:fee|profit)\b|\bfixed\s*fee\b|\bAWAF\b|\bCPFF\b", 8, 15),
)
LABOR_BASE = ("direct labor", "labor cost", "labor base", "direct cost")
TERM = r"(?i)\b(?:base|option)\s+(?:year|period)s?\s*(?:\d+|[IVX]+)?|\b\d+\s*-?\s*(?:year|month)s?\b"
DATE = r"\b(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4})\b"
COMPANY = r"\b([A-Z][A-Za-z&]+(?: [A-Z][A-Za-z&]+)*,? (?:Inc|LLC|Ltd|Corp|Corporation|Company|GmbH))\b"


def batch_summary(issues: DataFrame) -> DataFrame:
    """(severity, category, issues, documents) by severity, by category and in all; nulls stand for all."""
    return issues.groupingSets([["severity"], ["category"], []], "severity", "category").agg(F.count("*").alias("issues"), F.countDistinct("doc_id").alias("documents"))


def fix_groups(issues: DataFrame, least: int = 2) -> DataFrame:
    """(key, flagged, suggestion, n, first, last): equal fixes but for case and outer spaces, outside Style, in the first one's casing."""
    bare = lambda c: F.trim(F.lower(c))
    usable = issues.where((F.col("category") != "Style") & (F.trim("flagged") != "") & (F.trim("suggestion") != ""))
    first = F.min_by(F.struct("flagged", "suggestion"), "seq").alias("f")
    g = usable.groupBy(bare("flagged").alias("key"), bare("suggestion").alias("to")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), first)
    return g.where(F.col("n") >= least).select("key", "f.flagged", "f.suggestion", "n", "first", "last")


def fix_tier(category: Column, severity: Column, suggestion: Column) -> Column:
    """safe: spelling and punctuation with a suggestion that are not severe; manual: no suggestion or critical; else review."""
    has = F.coalesce(F.trim(suggestion), F.lit("")) != ""
    return F.when(~has | (severity == "Critical"), "manual").when(category.isin("Spelling", "Punctuation", "Grammar") & severity.isin("Low", "Info", "Medium"), "safe").otherwise("review")


def fix_statistics(issues: DataFrame, seconds: int = 15) -> DataFrame:
    """(tier, category, severity, issues, fixable, review_minutes) by tier, category, severity and in all; nulls stand for all."""
    has = F.coalesce(F.trim("suggestion"), F.lit("")) != ""
    named = issues.withColumn("tier", fix_tier(F.col("category"), F.col("severity"), F.col("suggestion")))
    return named.groupingSets([["tier"], ["category"], ["severity"], []], "tier", "category", "severity").agg(F.count("*").alias("issues"), F.count_if(has).alias("fixable"), F.round(F.count_if(has) * seconds / 60.0, 2).alias("review_minutes"))


def roles_from_history(occurrences: DataFrame, least: int = 2, sure: float = 0.7) -> DataFrame:
    """(name, times, confidence, category): names seen often and surely enough, without regard to case; the least known category wins."""
    known = F.min(F.when(~F.coalesce("category", F.lit("Unknown")).isin("Unknown", ""), F.col("category")))
    g = occurrences.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("times"), F.round(F.avg("confidence"), 6).alias("confidence"), F.coalesce(known, F.lit("Unknown")).alias("category"))
    return g.where((F.col("times") >= least) & (F.col("confidence") >= sure))


def learned_corrections(original: DataFrame, edited: DataFrame, least: int = 2) -> DataFrame:
    """(field, was, became, times): changes of a value made often enough; both: (key, field, value)."""
    new = edited.select("key", "field", F.col("value").alias("became"))
    changed = original.join(new, ["key", "field"]).where(~F.col("value").eqNullSafe(F.col("became")))
    return changed.groupBy("field", F.col("value").alias("was"), "became").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def link_scan_stats(history: DataFrame) -> DataFrame:
    """(source, scans, links, working, success_pct, last) by source and in all; history: (source, scan_time, total, working)."""
    rate = F.round(F.avg(F.col("working") * 100.0 / F.nullif("total", F.lit(0))), 6)
    return history.rollup("source").agg(F.count("*").alias("scans"), F.sum("total").alias("links"), F.sum("working").alias("working"), rate.alias("success_pct"), F.max("scan_time").alias("last"))


def exclusion_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.max("last_hit").alias("last_hit"))


def indirect_rates(items: DataFrame) -> DataFrame:
    """(proposal_id, rate, amount, implied_pct, outside): indirect costs by name against the vendor's direct labour; the last of a rate counts.

    items: (proposal_id, seq, description, amount).
    """
    low, text = F.lower("description"), F.col("description")
    base = items.groupBy("proposal_id").agg(F.sum(F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in LABOR_BASE]), F.coalesce("amount", F.lit(0.0))).otherwise(0.0)).alias("base"))
    one = [F.when(F.regexp_like(text, F.lit(p)), F.struct(F.lit(k).alias("rate"), F.lit(a).alias("low"), F.lit(b).alias("high"))) for k, p, a, b in RATES]
    found = items.select("proposal_id", "seq", F.coalesce("amount", F.lit(0.0)).alias("amount"), F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("r"))
    last = found.groupBy("proposal_id", "r").agg(F.max_by("amount", "seq").alias("amount")).join(base, "proposal_id")
    implied = F.when((F.col("base") > 0) & (F.col("amount") > 0), F.round(F.round(F.col("amount") / F.col("base") * 100, 6), 1))
    out = last.select("proposal_id", F.col("r.rate").alias("rate"), "amount", implied.alias("implied_pct"), "r.low", "r.high")
    return out.withColumn("outside", F.coalesce((F.col("implied_pct") < F.col("low")) | (F.col("implied_pct") > F.col("high")), F.lit(False))).drop("low", "high")


def completeness(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """(proposal_id, tables, items, metadata, coverage, overall): how much of a proposal was found, each of 100.

    proposals: (proposal_id, financial_tables, company, date, term, total); items: (proposal_id, description, category, amount).
    """
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    filled = lambda c: F.avg(c.cast("int"))
    per = items.groupBy("proposal_id").agg(F.count("*").alias("n"), F.round((filled(F.col("amount").isNotNull()) + filled(has("description")) + filled(F.coalesce("category", F.lit("")) != "Other")) / 3 * 100, 6).alias("c"))
    meta = reduce(lambda a, b: a + b, [F.when(has(c), p).otherwise(0) for c, p in (("company", 30), ("date", 20), ("term", 25), ("total", 25))])
    j = proposals.join(per, "proposal_id", "left").select("proposal_id", F.least(F.lit(100), F.col("financial_tables") * 25).alias("tables"), F.least(F.lit(100), F.coalesce("n", F.lit(0)) * 5).alias("items"), meta.alias("metadata"), F.round(F.coalesce("c", F.lit(0.0)), 1).alias("coverage"))
    return j.withColumn("overall", F.round(F.round(F.col("tables") * 0.3 + F.col("items") * 0.3 + F.col("metadata") * 0.2 + F.col("coverage") * 0.2, 6), 1))


def active_document_counts(roles: DataFrame, docs: DataFrame) -> DataFrame:
    """(role_id, documents, active): documents of each role and those in force; roles: (role_id, document_id), docs: (document_id, status)."""
    return roles.join(docs, "document_id", "left").groupBy("role_id").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct(F.when(F.col("status") == "active", F.col("document_id"))).alias("active"))


MONEY_CELL = r"^\s*\(?[$€£]\s*[\d,]+(?:\.\d+)?\)?\s*$"
NUMBER_CELL = r"^\s*[\d,]+(?:\.\d+)?\s*$"


def column_roles(cells: DataFrame, first: int = 10) -> DataFrame:
    """(table_id, col, role, money, numbers): what the columns of untyped tables hold, from their first rows.

    The widest text column is the description; of money columns the last is the amount and the one before it the price;
    the first column of plain numbers is the quantity. cells: (table_id, row, col, value).
    """
    share = lambda p: F.round(F.avg(F.regexp_like("value", F.lit(p)).cast("int")), 6)
    per = cells.where(F.col("row") < first).groupBy("table_id", "col").agg(share(MONEY_CELL).alias("money"), share(NUMBER_CELL).alias("numbers"), F.round(F.avg(F.length("value")), 6).alias("width"))
    kind = F.when(F.col("money") > 0.5, "money").when(F.col("numbers") > 0.5, "number").otherwise("text")
    typed = per.withColumn("kind", kind)
    w = Window.partitionBy("table_id", "kind")
    from_last, from_first, widest = (F.row_number().over(w.orderBy(*o)) for o in ([F.desc("col")], ["col"], [F.desc("width"), "col"]))
    placed = typed.select("*", from_last.alias("from_last"), from_first.alias("from_first"), widest.alias("widest"))
    role = F.when((F.col("kind") == "money") & (F.col("from_last") == 1), "amount").when((F.col("kind") == "money") & (F.col("from_last") == 2), "unit_price").when((F.col("kind") == "number") & (F.col("from_first") == 1), "quantity").when((F.col("kind") == "text") & (F.col("widest") == 1), "description").otherwise("other")
    return placed.select("table_id", "col", role.alias("role"), "money", "numbers")


def financial_tables(cells: DataFrame, header: str = r"(?i)\b(price|cost|amount|total|rate)\b", share: float = 0.15, column_share: float = 0.4) -> DataFrame:
    """Tables (table_id, financial): header words, enough money cells in all, or a column of them."""
    money = F.regexp_like("value", F.lit(MONEY_CELL)).cast("int")
    per = cells.groupBy("table_id", "col").agg(F.sum(money).alias("m"), F.count("*").alias("n"), F.max((F.col("row") == 0) & F.regexp_like("value", F.lit(header))).alias("named"))
    return per.groupBy("table_id").agg((F.max("named") | (F.sum("m") / F.sum("n") > share) | (F.max(F.col("m") / F.col("n")) > column_share)).alias("financial"))


def comparison_history(comparisons: DataFrame, projects: DataFrame, n: int) -> DataFrame:
    """The newest comparisons with their project's name, vendors, total and spread from the saved JSON result."""
    result = F.from_json("result", "vendors array<string>, total double, spread double")
    named = comparisons.join(projects, "project_id", "left").withColumn("r", result)
    return named.orderBy(F.desc("created"), F.desc("comparison_id")).limit(n).select("comparison_id", "project", F.size("r.vendors").alias("vendors"), F.col("r.total").alias("total"), F.col("r.spread").alias("spread"), "created")


def statements_of_roles(stmts: DataFrame, roles: DataFrame, most_words: int = 3) -> DataFrame:
    """(statement_id, canonical, how): the role a statement names, and roles whose names of up to `most_words` words its text holds.

    stmts: (statement_id, role, text); roles: (canonical, variant). Names of fewer than three letters are not looked for.
    """
    low = roles.select("canonical", F.lower("variant").alias("variant")).distinct()
    named = stmts.join(low, F.lower("role") == F.col("variant")).select("statement_id", "canonical", F.lit("explicit").alias("how"))
    w = stmts.select("statement_id", F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower).alias("w"))

    def of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, every).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[of(n) for n in range(1, most_words + 1)]))
    said = w.select("statement_id", F.explode(F.array_distinct(grams)).alias("variant")).join(low.where(F.length("variant") >= 3), "variant").select("statement_id", "canonical", F.lit("text").alias("how"))
    return named.unionByName(said).groupBy("statement_id", "canonical").agg(F.min("how").alias("how"))


def unmapped(stmts: DataFrame, mapped: DataFrame) -> DataFrame:
    """Statements without a role, and the share of those with one in percent, in one row."""
    j = stmts.select("statement_id").join(mapped.select("statement_id").distinct().withColumn("hit", F.lit(1)), "statement_id", "left")
    return j.agg(F.count("*").alias("statements"), F.count("hit").alias("mapped"), F.round(F.count("hit") * 100.0 / F.count("*"), 6).alias("coverage_pct"))


def role_positions(docs: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(doc_id, name, pos): every place of a listed one-word name, as a whole word in any case; pos counts words from 0."""
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-zA-Z0-9]+"), F.lit(0))).alias("pos", "word"))
    return words.join(whitelist.select("name", F.lower("name").alias("key")), F.lower("word") == F.col("key")).select("doc_id", "name", "pos")


def canonicalised(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names (id, name) with `canonical`: the whole name's alias, else each word replaced by its own alias."""
    a = aliases.select(F.lower("alias").alias("alias"), "canonical").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    whole = names.join(a, F.lower("name") == F.col("alias"), "left").drop("alias")
    words = names.select("id", F.posexplode(F.split("name", " ")).alias("pos", "word")).join(a, F.lower("word") == F.col("alias"), "left")
    built = words.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical", "word").alias("w")))), lambda x: x["w"]), " ").alias("built"))
    return whole.join(built, "id").select("id", "name", F.coalesce("canonical", "built").alias("canonical"))


def sentence_pairs(hits: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, weight): roles in one sentence often enough, without those that an edge (source, target) joins already.

    hits: (doc_id, sent_idx, role); the pairs of a sentence are made inside its row.
    """
    roles = hits.groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_set("role")).alias("r")).where("size(r) > 1")
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.filter("r", lambda y, j: j > i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    n = roles.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    known = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return n.join(known, ["a", "b"], "left_anti").withColumn("weight", F.col("n") * 0.5)


def typed_relationships(sents: DataFrame, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """(type, source, target, n): edges between the two groups of each type's pattern, in lower case."""
    one = F.array(*[F.struct(F.lit(t).alias("type"), F.lower(F.regexp_extract("text", p, 1)).alias("source"), F.lower(F.regexp_extract("text", p, 2)).alias("target")) for t, p in patterns])
    return sents.select(F.inline(one)).where("source <> '' AND target <> ''").groupBy("type", "source", "target").agg(F.count("*").alias("n"))


def detected_category(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, code): the longest function code that stands in the upper-case name before a number, or between marks.

    Codes meet names by equal parts, not by pattern: a name is cut at marks, and a part's letters are its code.
    """
    parts = F.array_distinct(F.filter(F.transform(F.split(F.upper("name"), r"[-_ .#]+"), lambda p: F.regexp_extract(p, "^([A-Z]+)", 1)), lambda p: p != ""))
    found = docs.select("doc_id", F.explode(parts).alias("code")).join(codes.select("code").distinct(), "code")
    return top_k(found.withColumn("n", F.length("code")), ["doc_id"], [F.desc("n"), F.asc("code")], 1).select("doc_id", "code")


def cross_functional(mentions: DataFrame, roles: DataFrame, docs: DataFrame) -> DataFrame:
    """(owner, function, roles, mentions): roles of one function in documents of another; roles: (role_id, owner), docs: (document_id, function)."""
    j = mentions.join(roles, "role_id").join(docs, "document_id").where("owner <> function")
    return j.groupBy("owner", "function").agg(F.countDistinct("role_id").alias("roles"), F.sum("mention_count").alias("mentions"))


def role_context(mentions: DataFrame, name: str) -> DataFrame:
    """Mentions of one role by its name, else by its name without case and marks; mentions: (document_id, role, mention_count)."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    exact = F.col("role") == name
    hit = mentions.where(exact | (bare("role") == bare(F.lit(name)))).withColumn("exact", exact)
    found = hit.agg(F.max("exact").alias("any"))  # one row
    return hit.join(F.broadcast(found)).where("exact OR NOT any").select("document_id", "role", "mention_count")


def documents_by_source(docs: DataFrame, like: str) -> DataFrame:
    return docs.where(F.ilike(F.col("source_url"), F.lit(like))).orderBy(F.desc("last_scan"), "document_id")


def validated_hits(hits: DataFrame, paras: DataFrame) -> DataFrame:
    """Hits (doc_id, para_idx, start, flagged) that occur in their paragraph, with `found`: at the offset, there in another case, or elsewhere."""
    j = hits.join(paras, ["doc_id", "para_idx"])
    there = F.substr("text", F.col("start") + 1, F.length("flagged"))
    found = F.when(there == F.col("flagged"), "exact").when(F.lower(there) == F.lower("flagged"), "case").when(F.contains(F.lower("text"), F.lower("flagged")), "moved")
    return j.withColumn("found", found).where("found is not null").select(*hits.columns, "found")


def outside_targets(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, metric, value, issue): metrics outside the band of their target (metric, low, high)."""
    j = metrics.join(targets, "metric")
    issue = F.when(F.col("value") < F.col("low"), "too_low").when(F.col("value") > F.col("high"), "too_high")
    return j.withColumn("issue", issue).where("issue is not null").select("doc_id", "metric", "value", "issue")


def in_order(issues: DataFrame) -> DataFrame:
    """Errors first, then warnings and the rest; by name and place inside."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.orderBy(rank, "name", "seq")


def concept_synonyms(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, group, members, n): documents that use several words of a synonym group (group, term)."""
    words = docs.select("doc_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return words.join(groups, "term").groupBy("doc_id", "group").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("members"), F.sum("n").alias("n")).where(F.contains("members", F.lit(",")))


def parse_sipoc(rows: DataFrame) -> DataFrame:
    """(row_id, place, kind, name, attributes, active): resources of a row's semicolon list; `[S] ` marks a tool.

    rows: (row_id, resources, attributes 'key: value; ...', flag).
    """
    item = F.trim(F.col("item"))
    cut = rows.select("row_id", "attributes", "flag", F.posexplode(F.split("resources", ";")).alias("place", "item")).where(item != "")
    tool = F.startswith(item, F.lit("[S] "))
    pairs = F.map_from_entries(F.transform(F.filter(F.split("attributes", ";"), lambda p: F.contains(p, F.lit(":"))), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)), F.trim(F.regexp_extract(p, r"^[^:]*:(.*)$", 1)))))
    return cut.select("row_id", "place", F.when(tool, "tool").otherwise("role").alias("kind"), F.regexp_replace(item, r"^\[S\] ", "").alias("name"), pairs.alias("attributes"), F.lower(F.trim("flag")).isin("yes", "y", "true", "1", "x").alias("active"))


def sipoc_edges(parsed: DataFrame) -> DataFrame:
    """(source, target, type): the first resource of a row inherits from the others and uses its tools."""
    first = parsed.where("kind = 'role'").groupBy("row_id").agg(F.min(F.struct("place", "name")).alias("p")).select("row_id", F.col("p.place").alias("first"), F.col("p.name").alias("source"))
    kind = F.when(F.col("kind") == "tool", "uses-tool").otherwise("inherits-from")
    return parsed.join(first, "row_id").where("place <> first").select("source", F.col("name").alias("target"), kind.alias("type")).dropDuplicates()


def apply_fixes(text: Column, fixes: tuple[tuple[str, str], ...]) -> Column:
    """Every (regular expression, replacement) in turn."""
    return reduce(lambda t, f: F.regexp_replace(t, f[0], f[1]), fixes, text)


def contract_facts(text: Column, chars: int = 5_000) -> tuple[Column, Column, Column]:
    """(term, company, date) first named in the beginning of a proposal, null without one."""
    head = F.substring(text, 1, chars)
    one = lambda p, g: F.nullif(F.trim(F.regexp_extract(head, p, g)), F.lit(""))
    return one(TERM, 0), one(COMPANY, 1), one(DATE, 1)


def role_category(name: Column, words: tuple[tuple[str, str], ...]) -> Column:
    """The first category whose pattern the lower-case name matches, else 'Unknown'."""
    return F.coalesce(*[F.when(F.regexp_like(F.lower(name), F.lit(p)), c) for c, p in words], F.lit("Unknown"))


def deliverables(sents: DataFrame, kinds: tuple[tuple[str, str], ...]) -> DataFrame:
    """(doc_id, para_idx, name, kind): work products in capitals that end in report, plan and the like, typed by keyword."""
    hits = F.regexp_extract_all("text", F.lit(r"(?:[A-Z][A-Za-z]+ )+(?:Report|Plan|Specification|Manual|List|Schedule)"), F.lit(0))
    found = sents.select("doc_id", "para_idx", F.explode(F.array_distinct(hits)).alias("name"))
    return found.withColumn("kind", role_category(F.col("name"), kinds))


def role_mentions(sents: DataFrame, heads: tuple[str, ...], aliases: DataFrame) -> DataFrame:
    """(doc_id, para_idx, role, n): capitalised names that end in a head word (Manager, Crew), under their canonical name.

    Names are few and each comes everywhere, so mentions stay where they are and the list of aliases goes to them.
    """
    pattern = r"(?:[A-Z][A-Za-z]+ )*(?:" + "|".join(heads) + ")"
    hits = sents.select("doc_id", "para_idx", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("name"))
    bare = hits.withColumn("name", F.regexp_replace("name", "^(?:The|A|An|See|Each|Of) ", ""))
    a = aliases.select(F.lower("alias").alias("key"), "canonical")
    return bare.join(F.broadcast(a), F.lower("name") == F.col("key"), "left").groupBy("doc_id", "para_idx", F.coalesce("canonical", "name").alias("role")).agg(F.count("*").alias("n"))


def roles_from_tables(cells: DataFrame, header: str = r"(?i)\b(role|responsible|owner|position)\b") -> DataFrame:
    """(table_id, role, confidence): names under a column whose header names roles, in tables that look like responsibility tables.

    A table is one if a header cell names roles, or over 60 % of its other cells are R, A, C or I.
    """
    letter = F.regexp_like("value", F.lit(r"^\s*[RACI](?:\s*/\s*[RACI])?\s*$"))
    per = cells.groupBy("table_id").agg(F.max((F.col("row") == 0) & F.regexp_like("value", F.lit(header))).alias("named"), F.round(F.avg(F.when((F.col("row") > 0) & (F.col("col") > 0), letter.cast("int"))), 6).alias("raci"))
    good = per.where("named OR raci > 0.6").select("table_id", "named", F.coalesce(F.col("raci") > 0.6, F.lit(False)).alias("grid"))
    columns = cells.where((F.col("row") == 0) & (F.regexp_like("value", F.lit(header)) | (F.col("col") == 0))).select("table_id", "col", F.regexp_like("value", F.lit(header)).alias("own"))
    chosen = columns.join(good, "table_id").where("own OR (grid AND NOT named)").select("table_id", "col", "grid").distinct()
    names = cells.where("row > 0").join(chosen, ["table_id", "col"]).where((F.trim("value") != "") & ~letter)
    return names.groupBy("table_id", F.trim("value").alias("role")).agg(F.max(F.when(F.col("grid"), 0.95).otherwise(0.85)).alias("confidence"))


def long_form(short: Column, before: Column) -> Column:
    """The words before a parenthesised short form that spell it by their first letters, or null.

    The words of the last `3 * length + 5` characters are walked backwards; each that begins with the wanted letter
    takes it, others are skipped, and the long form begins at the word that takes the first letter.
    """
    text = F.trim(before)
    width = F.least(F.length(short) * 3 + 5, F.length(text))
    words = F.filter(F.split(F.regexp_replace(F.trim(F.substr(text, F.length(text) - width + 1, width)), r"[\s.,;:]+$", ""), r"\s+"), lambda w: w != "")
    start = F.struct(F.length(short).alias("left"), F.lit(0).alias("i"), F.lit(0).alias("taken"))

    def step(s: Column, word: Column) -> Column:
        fits = (s["left"] > 0) & (F.upper(F.substring(word, 1, 1)) == F.substr(F.upper(short), s["left"], F.lit(1)))
        i = s["i"] + 1
        return F.struct((s["left"] - F.when(fits, 1).otherwise(0)).alias("left"), i.alias("i"), F.when(fits, i).otherwise(s["taken"]).alias("taken"))

    end = F.aggregate(F.reverse(words), start, step)
    found = F.array_join(F.slice(words, F.size(words) - end["taken"] + 1, F.greatest(end["taken"], F.lit(1))), " ")
    return F.when((F.size(words) > 0) & (end["left"] == 0) & (F.length(found) > F.length(short)), found)


def standard_scores(reqs: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, requirements, clean, score): share of a document's requirements without any issue, in percent."""
    bad = issues.select("doc_id", "para_idx").distinct().withColumn("bad", F.lit(1))
    j = reqs.select("doc_id", "para_idx").join(bad, ["doc_id", "para_idx"], "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("requirements"), F.count_if(F.col("bad").isNull()).alias("clean")).withColumn("score", F.round(F.col("clean") * 100.0 / F.col("requirements"), 6))
