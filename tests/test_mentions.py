import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import mentions as M

LINES = [
    "The Systems Engineer shall review the plan. The Test Director's authority is wide.",
    "Please notify the Program Managers, or inform Safety Engineer in time. Acting as the Chief Engineer for us.",
    "Drawings are approved by the Change Control Board. The Project Manager (PM) is responsible for keeping order here; more.",
    "It requires approval from the Technical Lead and the Quality Manager.",
    "Lead Design Engineer ensures safety. The integrator supports the work by Test Author and Review Board on site.",
    "Known responsibilities of the Sys Engineer include tests, as performed by the Vendor and others. Owner in managing",
    "no name here", "", ".", "The Project Manager shall do this. The Project Manager shall do that",
]


@pytest.fixture(scope="module")
def lists(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    return one("test director"), one("mission assurance"), one("progress")


def paras(spark, lines):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, para_idx int, text string")


def test_places_equal_those_of_whole_paragraphs_with_lookahead(spark):
    want = set()
    for i, line in enumerate(LINES):
        for rank, p in enumerate(M.PATTERNS):
            body = p.regex() if not p.end else p.regex()[: -len(p.end)] + f"(?={p.end})"
            for m in re.finditer(body, line, re.MULTILINE):
                start, end = max(0, line.rfind(".", 0, m.start()) + 1), line.find(".", m.end())
                context = " ".join(line[start : end + 1 if end >= 0 else len(line)].split())
                for part in range(2 if p.both else 1):
                    want.add((i, m.start(), rank, part, m.group(2 + part), context))
    firsts = {i: [0, *[k + 1 for k, c in enumerate(t) if c == "."]] for i, t in enumerate(LINES)}
    rows = M.found_names(paras(spark, [*LINES, None])).collect()
    got = {(r.para_idx, firsts[r.para_idx][r.sent_idx] + r.spot - 1, r.rank, r.part, r.name, r.context) for r in rows}
    assert len(rows) == len(want)
    assert got == want
    assert len({x[2] for x in want}) >= 20


def test_mentions(spark, lists):
    rows = M.role_mentions(paras(spark, LINES), *lists).collect()
    assert len({(r.para_idx, r.sent_idx, r.spot, r.role) for r in rows}) == len(rows)
    by = {(r.para_idx, r.role): r for r in rows}
    assert by[0, "Systems Engineer"].action == "reviews" and by[0, "Systems Engineer"].responsibility == "the plan"
    assert by[2, "Project Manager"].action == "performs" and by[2, "Project Manager"].responsibility == "keeping order here"
    assert by[5, "Systems Engineer"].name == "Sys Engineer" and (1, "Program Manager") in by and (3, "Technical Lead") in by
    assert sum(r.para_idx == 9 and r.pattern == "the_role" for r in rows) == 2
    assert not M.role_mentions(paras(spark, []), *lists).count()
    counts = {(r.role, r.doc_id): r.mentions for r in M.role_document_counts(M.role_mentions(paras(spark, LINES), *lists)).collect()}
    assert counts["Project Manager", 1] == sum(r.role == "Project Manager" for r in rows)


def test_cleaning(spark):
    cases = {"The Manager And": "Manager", "ofthedepartment": "", "ByaSafetyDepartment": "", "Fa Ci Li Ties": "", "Technical Leads": "Technical Leads", "Engineer leads": "Engineer", "Manager manages project now": "Manager", "shall Reviewer": "Reviewer", "Test Engineer tests system": "Test Engineer", "and or": "", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r.name: r.c for r in df.select("name", M.candidate(F.col("name")).alias("c")).collect()} == cases


def test_names_and_actions_without_any(spark):
    row = spark.sql("SELECT 'pp&c lead' AS a, 'System Safety Engineer' AS b, 'no role here' AS c, '' AS d").select(M.canonical_name(F.col("a")).alias("a"), M.canonical_name(F.col("b")).alias("b"), *[x.alias(n) for x, n in zip(M.action(F.col("c"), F.col("b")), "cd")], M.action(F.col("c"), F.col("d"))[0].alias("e")).first()
    assert tuple(row) == ("PP&C Lead", "Safety Engineer", "unknown", "", "unknown")


def test_only_patterns_that_a_text_may_hold_are_scanned_and_none_is_missing(spark):
    texts = [*LINES, "Reports by\x0bthe\tProject\x0bManager, who", "A The Systems Engineer shall", "éThe Chief Engineer will see", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", M.fitting(M.PATTERNS)(F.col("text")).alias("fits"), *[F.regexp_like("text", F.lit(p.regex())).alias(f"p{i}") for i, p in enumerate(M.PATTERNS)]).collect()
    for r in rows:
        assert {i for i in range(len(M.PATTERNS)) if r[f"p{i}"]} <= set(r.fits), r.text
    fits = {r.text: r.fits for r in rows}
    assert fits["no name here"] == fits[""] == fits[None] == [] and fits[texts[len(LINES)]] and sum(map(len, fits.values())) < len(texts) * 8
