import re

import pytest

from inkwell.operators import packs as P
from inkwell.operators import rules as R
from inkwell.operators import statements as S
from inkwell.operators import text as T


def plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "2000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, para_idx int, text string")


def test_a_statement_is_directed_once(spark):
    found = S.statements(lines(spark, "1. Scope", "The crew shall stop it now.  The crew is RESPONSIBLE FOR\nit all.", None, "Nothing is said here at all."))
    assert plan(found).count("is accountable for") == 1  # not in a filter and again in its column
    assert [(r.number, r.directive, r.statement) for r in found.orderBy("number").collect()] == [("1.1", "shall", "The crew shall stop it now."), ("1.2", "responsible", "The crew is RESPONSIBLE FOR it all.")]


def test_punctuation_is_scanned_where_it_may_be(spark):
    rows = ["|  cell  |  other", "Chapter 4   begins  here, it runs", "Some  text, however it runs", "plain text, moreover\vthis", "a  b and  c 4.", "SECTION  5  is long", "été,  il  va"]
    paras = lines(spark, *rows)
    found = P.punctuation_rules(paras)
    assert "ArrowEvalPython" in plan(found)
    spaced = re.compile("|".join(f"(?:{p})" for p in P.SPACED))
    want = {(i, "PUN001", len(re.findall("  +", t.lstrip()))) for i, t in enumerate(rows) if len(t.strip()) >= 10 and not spaced.search(t) and "  " in t.lstrip()}
    assert {(r.para_idx, r.rule_id, r.n) for r in found.where("rule_id = 'PUN001'").collect()} == want
    assert {(r.para_idx, r.flagged) for r in found.where("rule_id = 'PUN002'").collect()} == {(1, ", it runs"), (2, ", however"), (3, ", moreover")}


def test_requirement_terms_are_found_in_one_scan(spark):
    texts = [f"The unit shall take {t} steps and must run {u}" for t in S.AMBIGUOUS[::3] for u in ("", "[TBD], etc. tbrx", "in 5 ms, shall be tested")]
    reqs = S.requirements(lines(spark, *texts, "It should shall and\nwill be.", "a may b"))
    found = S.requirement_issues(reqs)
    assert "ArrowEvalPython" in plan(found)
    got = {(r.para_idx, r.issue, r.flagged) for r in found.where("issue in ('escape_clause', 'ambiguous')").collect()}
    low = {r.para_idx: r.text.lower() for r in reqs.collect()}
    want = {(i, "escape_clause", t) for i, x in low.items() for t in S.ESCAPES if t in x}
    want |= {(i, "ambiguous", t) for i, x in low.items() for t in S.AMBIGUOUS if re.search(S.word_pattern(t), x)}
    assert got == want
    many = {r.para_idx for r in found.where("issue = 'atomicity' and severity = 'warning'").collect()}
    assert many == {i for i, x in low.items() if len(re.findall(r"\b(shall|must|will)\b", x)) > 1}


def test_a_review_reads_its_paragraphs_once(spark):
    docs = spark.createDataFrame([(1, "And the the pump.  Had had it.\nPage 3 of 4\nBut it is it is is fine!\r\n  But\tno"), (2, None), (3, " ".join(["word"] + [f"w{i}" for i in range(45)]))], "doc_id long, text string")
    found = R.review_issues(docs)
    assert "Union" not in plan(found)
    got = sorted((r.doc_id, r.para_idx, r.seq - r.para_idx * 10_000_000, r.rule_id, r.flagged) for r in found.collect())
    assert [g[:4] for g in got] == [(1, 0, 0, "repeated_word"), (1, 0, 2_000_000, "initial_conjunction"), (1, 2, 0, "repeated_word"), (1, 2, 2_000_000, "initial_conjunction"), (1, 3, 2_000_000, "initial_conjunction"), (3, 0, 1_000_000, "long_sentence")]
    assert [g[4] for g in got][:4] == ["the the", "And the the pump.", "is is", "But it is it is is fine!"]


@pytest.mark.parametrize("text", ["  COPYRIGHT 2020 x", "see HTTPS://x.y", "x provided BY ihs", "TO PLACE an ORDER", " page 3/4", "....12", "an Issued 2020", "www.x.org", "www.x.net", "RATIONALE \r", "kWithout license from", "plain text"])
def test_boilerplate_in_two_parts(spark, text):
    got = lines(spark, text).select(T.is_boilerplate(R.F.col("text"))).first()[0]
    assert got == bool(re.search(T.BOILERPLATE_PATTERN, text))
