"""Documents against standards: rules as data, elements that a document must have, and issues by the standards' clauses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.packs import flat
from inkwell.operators.rules import Rule, normal_category, regex_scan


@dataclass(frozen=True)
class Element:
    """Something a document must hold: any of the terms, in lower case."""

    standard: str
    rule_id: str
    terms: tuple[str, ...]
    severity: str = "High"


def _rule(standard: str, rule_id: str, pattern: str, severity: str = "Medium") -> Rule:
    return Rule(rule_id, standard, "regex", pattern, severity, standard)


#: Everything below is fixed values: what the standards forbid or ask for; patterns are for text in lower case.
STANDARD_RULES = [
    _rule("MIL-STD-40051", "MILSTD040", r"\bdo not\b"),
    _rule("MIL-STD-40051", "MILSTD041", r"\betc\.?\b"),
    _rule("MIL-STD-40051", "MILSTD042", r"\bcarefully\b"),
    _rule("MIL-STD-40051", "MILSTD043", r"\bproperly\b"),
    _rule("MIL-STD-40051", "MILSTD044", r"\bapproximately\b"),
    _rule("MIL-STD-40051", "MILSTD045", r"\bas\s+required\b"),
    _rule("MIL-STD-40051", "MILSTD046", r"\bif\s+necessary\b"),
    _rule("MIL-STD-40051", "MILSTD047", r"\bperiodically\b"),
    _rule("AS9100", "AS9100-REQUIREMENT_REFS", r"\b(?:per|ref|reference|see)\s+(?:requirement|req\.?|rq)[-\s]?\d+", "Info"),
    _rule("AS9100", "AS9100-QUALITY_RECORDS", r"\bquality\s+record", "Info"),
    _rule("AS9100", "AS9100-RISK_REFERENCE", r"\brisk\s+(?:assessment|analysis|mitigation|management)", "Info"),
]
ELEMENTS = (
    Element("AS9100", "AS9100-REVISION_MARKER", ("revision", "rev.", "rev:", "version", "issue")),
    Element("AS9100", "AS9100-APPROVAL_MARKER", ("approved by", "approval", "authorized by", "approved:")),
    Element("AS9100", "AS9100-EFFECTIVE_DATE", ("effective date", "issue date", "date:", "dated:")),
)
CLAUSES = {
    "MIL-STD-961": {
        "passive_voice": "5.1.2 - Clear Requirements", "weak_language": "5.1.3 - Definitive Language", "ambiguous_pronouns": "5.1.4 - Unambiguous",
        "testability": "5.1.5 - Verifiable", "atomicity": "5.1.6 - Single Requirement",
    },
    "AS6500": {"requirements_language": "4.2 - Design Analysis", "roles": "4.5.8 - Supplier Management", "acronyms": "2.2 - Definitions"},
    "DO-178C": {"testability": "6.3 - Verification", "ambiguous_pronouns": "6.2 - Clarity", "tbd": "6.1 - Completeness"},
}


def missing_elements(docs: DataFrame, elements: tuple[Element, ...] = ELEMENTS) -> DataFrame:
    """(doc_id, standard, rule_id, severity) of every element that a document lacks; a null text lacks all."""
    text = F.lower(F.coalesce("text", F.lit("")))
    one = lambda e: F.struct(F.lit(e.standard).alias("standard"), F.lit(e.rule_id).alias("rule_id"), F.lit(e.severity).alias("severity"), F.greatest(*[F.contains(text, F.lit(t)) for t in e.terms], F.lit(False)).alias("held"))
    return docs.select("doc_id", F.inline(F.filter(F.array(*map(one, elements)), lambda r: ~r["held"]))).drop("held")


def standard_issues(docs: DataFrame, paras: DataFrame, rules: list[Rule] = STANDARD_RULES, elements: tuple[Element, ...] = ELEMENTS) -> DataFrame:
    """(doc_id, para_idx, standard, rule_id, severity, flagged): hits of the rules, and missing elements at paragraph 0, one pass each."""
    hits = regex_scan(paras.select("doc_id", "para_idx", flat(F.col("text")).alias("text")), rules)
    found = hits.select("doc_id", "para_idx", F.col("category").alias("standard"), "rule_id", "severity", F.col("hit").alias("flagged"))
    return found.unionByName(missing_elements(docs, elements).select("doc_id", F.lit(0).alias("para_idx"), "standard", "rule_id", "severity", F.lit("").alias("flagged")))


def compliance_matrix(issues: DataFrame, clauses: dict[str, dict[str, str]] = CLAUSES) -> DataFrame:
    """(doc_id, standard, clause, issues, of_standard): issues (doc_id, category) by the clauses they offend.

    An issue whose category no clause names counts nowhere, one that several standards name counts in each.
    """
    name = F.replace(normal_category(F.col("category")), F.lit(" "), F.lit("_"))
    every = [F.struct(F.lit(s).alias("standard"), F.lit(k).alias("key"), F.lit(c).alias("clause")) for s, of in clauses.items() for k, c in of.items()]
    hit = issues.select("doc_id", F.inline(F.filter(F.array(*every), lambda x: x["key"] == name)))
    per = hit.groupBy("doc_id", "standard", "clause").agg(F.count("*").alias("issues"))
    whole = per.groupBy("doc_id", "standard").agg(F.sum("issues").alias("of_standard"))
    return per.join(whole, ["doc_id", "standard"]).select("doc_id", "standard", "clause", "issues", "of_standard")
