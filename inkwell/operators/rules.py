"""Rule packs as data, the scans that apply them, and what becomes of the issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.text import grade, issue_id, lower_words, words
from inkwell.operators.metrics import top_k
from inkwell.operators.text import cut_sentences, drop_boilerplate, is_repeat, paragraphs, repeats, sentences

ISSUE = "doc_id long, para_idx int, seq long, category string, severity string, rule_id string, message string, flagged string, suggestion string"
#: What an issue of each severity takes from a score (fixed values).
SEVERITY_WEIGHTS = {"Critical": 15.0, "High": 5.0, "Medium": 2.0, "Low": 0.5, "Info": 0.1}
#: What an issue of each severity counts in a document's summary (fixed values).
SUMMARY_WEIGHTS = {"Critical": 4.0, "High": 3.0, "Medium": 2.0, "Low": 1.0, "Info": 0.5}
#: Categories that say the same, by the name they are compared under (fixed values).
SAME_CATEGORY = {
    "requirement traceability": "req_traceability",
    "incose compliance": "req_traceability",
    "requirements analysis": "req_traceability",
    "acronyms": "acronyms",
    "enhanced acronyms": "acronyms",
    "acronym first-use enforcement": "acronyms",
    "acronym multiple definition": "acronyms",
    "keyword extraction": "acronyms",
    "vague quantifier": "vague_scope",
    "ambiguous scope": "vague_scope",
    "quantifier precision": "vague_scope",
    "requirements": "testability",
    "verification method": "testability",
    "passive voice": "passive_voice",
    "enhanced passive voice": "passive_voice",
    "grammar": "grammar",
    "grammar (comprehensive)": "grammar",
    "spelling": "spelling",
    "spelling (enhanced)": "spelling",
    "cross-reference validation": "cross_references",
    "cross-reference target validator": "cross_references",
    "unresolved cross-reference": "cross_references",
    "style (professional)": "prose_style",
    "prose quality": "prose_style",
    "advanced prose lint": "prose_style",
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pack: str
    kind: str  # phrase or regex
    pattern: str
    severity: str
    category: str
    replacement: str = ""
    message: str = ""


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    schema = "rule_id string, pack string, kind string, pattern string, severity string, category string, replacement string, message string"
    return spark.createDataFrame([(r.rule_id, r.pack, r.kind, r.pattern, r.severity, r.category, r.replacement, r.message) for r in rules], schema)


FEW_WORDS = 200


def word_grams(n: int, firsts: list[str]) -> Column:
    """The n-grams of the array w, space-joined; only those that begin with one of the first words, if these are few."""
    starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
    if len(firsts) <= FEW_WORDS:
        known = F.array(*map(F.lit, firsts))
        starts = F.filter(starts, lambda i: F.array_contains(known, F.element_at("w", i)))
    return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))


def phrase_scan(paras: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, para_idx, rule columns): whole-word phrases by an equi-join of n-grams with the rules.

    Only the phrase lengths that occur among the rules are exploded; no regular expression runs per rule.
    """
    split = F.split(F.lower("pattern"), " ")
    by_length: dict[int, set[str]] = {}
    for n, first in rules.select(F.size(split), split[0]).distinct().collect():  # rules are a bounded table
        by_length.setdefault(n, set()).add(first)
    w = paras.select("doc_id", "para_idx", lower_words(F.col("text")).alias("w"))
    grams = None
    for n, firsts in sorted(by_length.items()):
        own = w.where(F.size("w") >= n).select("doc_id", "para_idx", F.explode(word_grams(n, sorted(firsts))).alias("gram"))
        grams = own if grams is None else grams.unionByName(own)
    return grams.join(rules, F.col("gram") == F.lower("pattern")).drop("gram")


def regex_scan(paras: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, para_idx, rule_id, severity, category, hit_idx, hit): every match of every regex rule, in one pass over the text."""
    one = lambda r: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("hits"))
    found = paras.select("doc_id", "para_idx", F.explode(F.array(*map(one, rules))).alias("r")).where(F.size("r.hits") > 0)
    return found.select("doc_id", "para_idx", "r.rule_id", "r.severity", "r.category", F.posexplode("r.hits").alias("hit_idx", "hit"))


def without_context(hits: DataFrame, paras: DataFrame, context: str) -> DataFrame:
    """Hits without those in a paragraph that matches the exempting context."""
    exempt = paras.where(F.regexp_like("text", F.lit(context))).select("doc_id", "para_idx")
    return hits.join(exempt, ["doc_id", "para_idx"], "left_anti")


def enabled_rules(rules: DataFrame, preset: DataFrame) -> DataFrame:
    """Rules whose pack the preset (pack, enabled, severity) turns on, with its severity where it names one."""
    p = preset.select("pack", "enabled", F.col("severity").alias("override"))
    return rules.join(p, "pack", "left").where(F.coalesce("enabled", F.lit(True))).withColumn("severity", F.coalesce("override", "severity")).drop("enabled", "override")


def long_sentences(paras: DataFrame, most: int) -> DataFrame:
    """(doc_id, para_idx, sent_idx, sentence, words) of sentences over so many words."""
    found = sentences(paras).withColumn("words", F.size(F.split("sentence", " ")))
    return found.where(F.col("words") > most)


def normal_category(category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SAME_CATEGORY.items() for x in pair])
    return F.coalesce(known[F.lower(category)], F.lower(category))


def dedupe_issues(issues: DataFrame) -> DataFrame:
    """The first issue of each (document, paragraph, category under its common name, first 80 flagged characters)."""
    key = ["doc_id", "para_idx", normal_category(F.col("category")), F.substring(F.coalesce("flagged", F.lit("")), 1, 80)]
    return issues.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("seq", "rule_id"))).where("place = 1").drop("place")


def quality_score(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, issues, score, grade) of every document of docs.

    100 less half of the deductions, 80 at most: a category's first issue weighs in full, its i-th by 1 / ln(i + 1), and
    with over 20 issues the sum is divided by log10(issues + 1). The score is cut to a whole number.
    """
    weight = F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHTS.items() for x in pair])
    i = F.row_number().over(Window.partitionBy("doc_id", normal_category(F.col("category"))).orderBy("seq", "rule_id"))
    counted = issues.withColumn("i", i).withColumn("takes", F.coalesce(weight[F.col("severity")], F.lit(0.5)) * F.when(F.col("i") == 1, F.lit(1.0)).otherwise(1 / F.log(F.col("i") + 1)))
    per = counted.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("takes"), 9).alias("takes"))
    total = F.coalesce(F.when(F.col("n") > 20, F.col("takes") / F.log10(F.col("n") + 1)).otherwise(F.col("takes")), F.lit(0.0))
    score = F.floor(F.lit(100) - F.least(F.lit(80.0), total / 2)).cast("int")
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("issues"), score.alias("score")).withColumn("grade", grade(F.col("score")))


def issue_summary(issues: DataFrame) -> DataFrame:
    """(doc_id, severity, category, issues, paragraphs) by document with subtotals; nulls stand for all."""
    named = issues.withColumn("category", normal_category(F.col("category")))
    return named.rollup("doc_id", "severity", "category").agg(F.count("*").alias("issues"), F.countDistinct("para_idx").alias("paragraphs"))


def document_summary(issues: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, issues, critical, fixable, weighted, density, paragraphs_with_issues, clean_paragraphs, top) of every document.

    Weighted sums SUMMARY_WEIGHTS (1 for another severity), density is issues per 1,000 words (per 1,000 without any), fixable
    has a suggestion other than '' and '-', top holds the k categories with most issues, ties by name. Null texts are empty.
    """
    weight = F.create_map(*[F.lit(x) for pair in SUMMARY_WEIGHTS.items() for x in pair])
    named = issues.withColumn("category", normal_category(F.col("category")))
    fixable = F.count_if(~F.coalesce("suggestion", F.lit("")).isin("", "-"))
    kinds = named.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "Critical").alias("critical"), fixable.alias("fixable"), F.sum(F.coalesce(weight[F.col("severity")], F.lit(1.0))).alias("weighted"), F.collect_set("para_idx").alias("paras"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))), 1, k)
    top = F.array_join(F.transform(best, lambda x: F.concat(x["category"], F.lit(" "), -x["n"])), ", ")
    marked = F.size(F.array_distinct(F.flatten(F.collect_list("paras")))).cast("long")
    per = kinds.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("critical").alias("critical"), F.sum("fixable").alias("fixable"), F.round(F.sum("weighted"), 1).alias("weighted"), marked.alias("marked"), top.alias("top"))
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", F.size(words(text)).alias("words"), F.size(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")).alias("paras"))
    none = lambda c, zero=0: F.coalesce(c, F.lit(zero))
    joined = sizes.join(per, "doc_id", "left")
    density = F.round(none("n") / F.greatest("words", F.lit(1)) * 1000, 2)
    return joined.select("doc_id", none("n").alias("issues"), none("critical").alias("critical"), none("fixable").alias("fixable"), none("weighted", 0.0).alias("weighted"), density.alias("density"), none("marked").alias("paragraphs_with_issues"), (F.col("paras") - none("marked")).alias("clean_paragraphs"), none("top", "").alias("top"))


def top_categories(issues: DataFrame, k: int = 3) -> DataFrame:
    n = issues.groupBy("doc_id", "category").agg(F.count("*").alias("n"))
    return top_k(n, ["doc_id"], [F.desc("n"), F.asc("category")], k)


def suppress_baselined(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues that are not accepted for their document: baseline has (doc_id, issue_id)."""
    named = issues.withColumn("issue_id", issue_id(F.col("para_idx"), F.col("category"), F.col("severity"), F.col("message"), F.col("flagged")))
    return named.join(baseline.select("doc_id", "issue_id").distinct(), ["doc_id", "issue_id"], "left_anti")


def learned_overrides(issues: DataFrame, dismissed: DataFrame, severities: DataFrame, least: int = 2) -> DataFrame:
    """Severity Info for categories dismissed often enough, else the severity that reviewers gave often enough."""
    down = dismissed.where(F.col("times") >= least).select("category", F.lit(True).alias("down")).distinct()
    given = top_k(severities.where(F.col("times") >= least), ["category"], [F.desc("times"), F.asc("severity")], 1).select("category", F.col("severity").alias("given"))
    joined = issues.join(down, "category", "left").join(given, "category", "left")
    return joined.withColumn("severity", F.when(F.col("down"), "Info").otherwise(F.coalesce("given", "severity"))).drop("down", "given")


def review_issues(docs: DataFrame) -> DataFrame:
    """The issues of a first review: repeated words, long sentences, and sentences that begin with a conjunction; in one pass."""
    issue = lambda at, category, severity, rule, flagged: F.struct(at.cast("long").alias("at"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"), flagged.alias("flagged"))
    repeated = F.filter(F.transform(repeats(F.col("text")), lambda h, i: issue(i, "Grammar", "Medium", "repeated_word", h)), lambda x: is_repeat(x["flagged"]))

    def of_sentence(s: Column, i: Column) -> Column:
        longest = F.when(F.size(F.split(s, " ")) > 40, issue(1_000_000 + i, "Sentence Length", "Low", "long_sentence", s))
        opening = F.lower(F.substring_index(s, " ", 1)).isin("and", "but", "or", "so", "for", "nor", "yet", "because", "also")
        return F.array(longest, F.when(opening, issue(2_000_000 + i, "Clarity", "Info", "initial_conjunction", s)))

    said = F.filter(F.flatten(F.transform(cut_sentences(F.col("text")), of_sentence)), lambda x: x.isNotNull())
    found = drop_boilerplate(paragraphs(docs)).select("doc_id", "para_idx", F.inline(F.concat(repeated, said)))
    return found.withColumn("seq", F.col("para_idx").cast("long") * 10_000_000 + F.col("at")).drop("at")


def review(docs: DataFrame) -> DataFrame:
    """Every document's number of issues, score and grade."""
    return quality_score(dedupe_issues(review_issues(docs)), docs)
