"""Literal fixtures for text parts, metrics and rules."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import metrics as M
from inkwell.operators import rules as R
from inkwell.operators import text as T


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("word", "n"), [("the", 1), ("table", 2), ("make", 1), ("idea", 3), ("banana", 3), ("rhythm", 1), ("pale", 1), ("", 0), ("naïve", 1), ("real", 1), ("another", 3), ("business", 3), ("higher", 2)])
def test_syllables(spark, word, n):
    assert value(spark, X.syllables(F.col("w")), w=word) == n


def test_small_functions(spark):
    assert value(spark, X.normalized_description(F.col("t")), t="The  Cost of Widgets #42") == "cost widgets"
    assert [value(spark, X.amount_bucket(F.col("a")), a=a) for a in (0.0, 50.0, -5_000.0, 2e8)] == ["$0", "$1-$99", "$1K-$9.9K", "$100M+"]
    assert value(spark, X.count_bucket(F.lit(None).cast("int")), a=1) == "none"
    assert value(spark, X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), a=1) == pytest.approx(1 / 3)
    assert value(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), a=1) == 0
    assert value(spark, X.fingerprint(F.col("t")), t=" A  b\n") == value(spark, X.fingerprint(F.col("t")), t="a B")
    assert value(spark, X.context(F.col("t"), F.lit(5), F.lit(3), 2), t="abcdefghijk") == "cdefghi"


def test_paragraphs_and_boilerplate(spark):
    paras = T.paragraphs(frame(spark, "One line here.\n\n  \nCopyright 2020 Someone", None, ""))
    assert [(r.doc_id, r.para_idx) for r in paras.orderBy("para_idx").collect()] == [(0, 0), (0, 3)]
    assert [r.text for r in T.drop_boilerplate(paras).collect()] == ["One line here."]


@pytest.mark.parametrize(("mode", "want"), [("space", ["One. ", "Two! three?", "four"]), ("capital", None), ("marks", None)])
def test_sentences(spark, mode, want):
    text = "Alpha one. beta two!  Gamma three? Delta"
    got = [r.sentence for r in T.sentences(frame(spark, text), mode).orderBy("sent_idx").collect()]
    assert got == {"space": ["Alpha one.", "beta two!", "Gamma three?", "Delta"], "capital": ["Alpha one. beta two!", "Gamma three?", "Delta"], "marks": ["Alpha one", "beta two", "Gamma three", "Delta"]}[mode]


def test_headings_and_sections(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["before", "1.2 Scope of work", "text", "GENERAL TERMS", "more", "## Notes", "end"])], "doc_id long, para_idx int, text string")
    got = [r.section for r in T.with_sections(lines).orderBy("para_idx").collect()]
    assert got == ["", "1.2 Scope of work", "1.2 Scope of work", "GENERAL TERMS", "GENERAL TERMS", "Notes", "Notes"]


def test_repeated_words(spark):
    got = [(r.doc_id, r.hit) for r in T.repeated_words(T.paragraphs(frame(spark, "The the cat, cat had had it it.", "é É x"))).orderBy("doc_id", "hit_idx").collect()]
    assert got == [(0, "The the"), (0, "it it"), (1, "é É")]


def test_readability_of_a_known_text(spark):
    r = M.readability(frame(spark, "The cat sat. The dog ran.", None, "...")).collect()
    assert len(r) == 1 and r[0].flesch_ease == pytest.approx(206.835 - 1.015 * 3 - 84.6) and r[0].smog is None


def test_metrics_of_nothing(spark):
    df = frame(spark, None, "", "12 !")
    assert all(r.words == 0 and r.word_length == 0 for r in M.basic_statistics(df).collect())
    assert [r.variety for r in M.sentence_variety(df).collect()] == [50.0] * 3
    assert [r.sttr for r in M.sttr(df).collect()] == [None] * 3
    for f in (M.vocabulary, M.complexity, M.windowed_ttr, M.keyword_frequency, M.repeated_phrases):
        assert f(df).count() == 0


def test_rules(spark):
    paras = T.paragraphs(frame(spark, "In order to win, we shall win in order to win.\nNothing"))
    rules = R.rules_table(spark, [R.Rule("a", "p", "phrase", "in order to", "Low", "Wordy", "to"), R.Rule("b", "q", "phrase", "win", "High", "Tone")])
    assert {r.rule_id: r["count"] for r in R.phrase_scan(paras, rules).groupBy("rule_id").count().collect()} == {"a": 2, "b": 3}
    preset = spark.createDataFrame([("p", True, "Medium"), ("q", False, None)], "pack string, enabled boolean, severity string")
    assert [(r.rule_id, r.severity) for r in R.enabled_rules(rules, preset).collect()] == [("a", "Medium")]
    assert R.regex_scan(paras, [R.Rule("r", "p", "regex", r"\bwin\b", "Low", "x")]).count() == 3


def issues(spark, rows):
    return spark.createDataFrame([(d, p, s, c, v, "r", "m", f) for d, p, s, c, v, f in rows], "doc_id long, para_idx int, seq long, category string, severity string, rule_id string, message string, flagged string")


def test_score_and_dedupe(spark):
    some = issues(spark, [(1, 0, 1, "Grammar", "High", "x"), (1, 0, 2, "Grammar (comprehensive)", "Low", "x"), (1, 1, 3, "Spelling", "Critical", "y"), (1, 2, 4, "Grammar", "High", "x")])
    once = R.dedupe_issues(some)
    assert sorted(r.seq for r in once.collect()) == [1, 3, 4]
    import math

    docs = frame(spark, "a", "b")
    got = {r.doc_id: (r.issues, r.score, r.grade) for r in R.quality_score(once, docs).collect()}
    assert got == {0: (0, 100, "A"), 1: (3, math.floor(100 - (5 + 5 / math.log(3) + 15) / 2), "B")}
    many = issues(spark, [(1, i, i, f"c{i}", "Critical", "") for i in range(40)])
    assert R.quality_score(many, docs).where("doc_id = 1").first().score == 20
    assert R.learned_overrides(some, spark.createDataFrame([("Grammar", 2), ("Spelling", 1)], "category string, times int"), spark.createDataFrame([("Spelling", "Low", 3)], "category string, severity string, times int")).where("category = 'Grammar'").select("severity").distinct().collect() == [("Info",)]


def test_suppressed_issues(spark):
    some = issues(spark, [(1, 0, 1, "Grammar", "High", "x"), (2, 0, 1, "Grammar", "High", "x")])
    ids = some.where("doc_id = 1").select("doc_id", X.issue_id(F.col("para_idx"), F.col("category"), F.col("severity"), F.col("message"), F.col("flagged")).alias("issue_id"))
    assert [r.doc_id for r in R.suppress_baselined(some, ids).collect()] == [2]
