import pytest

from inkwell.operators import rules as R
from inkwell.operators import standards as S
from inkwell.operators import structure
from inkwell.operators import terms as C
from inkwell.operators import text as T


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Rev. C, approved by Ann\nSee req 12 and do not stop, etc. now; tighten properly."), (2, "Nothing here"), (3, None), (4, "")], "doc_id long, text string")


def test_rules_and_missing_elements(docs):
    rows = {(r.doc_id, r.para_idx, r.rule_id, r.flagged) for r in S.standard_issues(docs, T.paragraphs(docs)).collect()}
    assert {r for r in rows if r[3]} == {(1, 1, "AS9100-REQUIREMENT_REFS", "see req 12"), (1, 1, "MILSTD040", "do not"), (1, 1, "MILSTD041", "etc"), (1, 1, "MILSTD043", "properly")}
    assert {(r[0], r[2]) for r in rows if not r[3]} == {(1, "AS9100-EFFECTIVE_DATE"), *((d, e.rule_id) for d in (2, 3, 4) for e in S.ELEMENTS)}


def test_matrix_counts_an_issue_in_every_standard(spark):
    issues = spark.createDataFrame([(1, "Testability"), (1, "Verification Method"), (1, "Weak Language"), (2, "Passive Voice"), (2, "Style"), (3, None)], "doc_id long, category string")
    rows = {(r.doc_id, r.standard, r.clause[:5]): (r.issues, r.of_standard) for r in S.compliance_matrix(issues).collect()}
    assert rows == {(1, "MIL-STD-961", "5.1.5"): (2, 3), (1, "MIL-STD-961", "5.1.3"): (1, 3), (1, "DO-178C", "6.3 -"): (2, 2), (2, "MIL-STD-961", "5.1.2"): (1, 1)}


def test_summary_of_issues(spark, docs):
    issues = spark.createDataFrame([(1, 0, "Style", "Critical", "x"), (1, 0, "Style", "Low", "-"), (1, 1, "Clarity", "High", ""), (1, 1, "Acronyms", "Odd", None), (1, 1, "Jargon", "Info", "y")], "doc_id long, para_idx int, category string, severity string, suggestion string")
    got = {r.doc_id: r for r in R.document_summary(issues, docs).collect()}
    one = got[1]
    assert (one.issues, one.critical, one.fixable, one.weighted, one.paragraphs_with_issues, one.clean_paragraphs) == (5, 1, 2, 9.5, 2, 0)
    assert one.top == "style 2, acronyms 1, clarity 1" and one.density == round(5 / 15 * 1000, 2)
    assert all((got[d].issues, got[d].density, got[d].top) == (0, 0.0, "") for d in (2, 3, 4)) and got[2].clean_paragraphs == 1 and got[3].clean_paragraphs == 0


def test_alternatives(spark, docs):
    listed = spark.createDataFrame([("Stop", "halt"), ("stop", "end"), ("ann", None), ("absent", "x")], "word string, alternative string")
    assert {(r.doc_id, r.word, r.alternative, r.n) for r in C.word_alternatives(docs, listed).collect()} == {(1, "stop", "end", 1), (1, "ann", "", 1)}


def test_tenses(spark):
    texts = {1: "He walked and runs. It will bring a bus. They sing!", 2: "The is are to a", 3: None, 4: "", 5: "Testing goes on; he went."}
    rows = {r.doc_id: (r.past, r.present, r.future, r.dominant, r.inconsistent) for r in structure.tenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows == {1: (1, 2, 1, "present", 2), 2: (0, 0, 0, "unknown", 0), 3: (0, 0, 0, "unknown", 0), 4: (0, 0, 0, "unknown", 0), 5: (1, 2, 0, "present", 1)}
