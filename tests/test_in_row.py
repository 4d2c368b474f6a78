import re
from collections import Counter

from pyspark.sql import functions as F

from inkwell.operators import metrics as M
from inkwell.operators import reports as R
from inkwell.operators import similar as S
from inkwell.operators import terms as C
from inkwell.plans import graphs as P
from inkwell.registry import table

TEXTS = [(1, "Pump pump PUMP valve Valve\n\npUMP don't Don't DON'T"), (2, None), (3, ""), (4, "alpha alpha beta the the\n" * 9 + "gamma gamma\n" * 3 + "\n"), (5, "Pump")]


def exchanges(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") + df._jdf.queryExecution().optimizedPlan().toString().count("Window")


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_items_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, None), (4, ["x"])], "id int, w array<string>")
    got = sorted((r.id, r["item"], r.n, r.before, r.after) for r in M.counted_in_row(rows, "w", lambda x: x["n"] > 0).where("before is not null or after is not null or id = 4").fillna("-").collect())
    assert got == [(1, "a", 1, "-", "b"), (1, "b", 3, "a", "c"), (1, "c", 1, "b", "-"), (4, "x", 1, "-", "-")]


def test_words_meet_their_frequency_once(spark):
    found = M.tfidf_keywords(docs(spark))
    assert exchanges(found) == 4  # document frequency, corpus size, place and its limit
    n, df = 5, {"alpha": 1, "beta": 1, "gamma": 1}
    got = {r.word: (r.place, round(r.score, 9)) for r in found.where("doc_id = 4").collect()}
    score = lambda k: round(k / 33 * (float(__import__("math").log((1 + n) / 2)) + 1), 9)
    assert set(got) == set(df) and got["alpha"] == (1, score(18)) and got["beta"] == (2, score(9)) and got["gamma"] == (3, score(6))


def test_only_words_of_several_forms_are_shuffled(spark):
    found = C.case_variants(docs(spark), shortest=2)
    got = {(r.doc_id, r.term, r.forms, r.n, r.dominant) for r in found.collect()}
    assert got == {(1, "pump", 3, 4, "pump"), (1, "don't", 2, 3, "don't")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # every form of every word met in a first one before
    assert docs(spark).where(F.col("doc_id") == 5).transform(C.case_variants).count() == 0


def test_crowding_words_are_counted_in_their_row(spark):
    lines = ["Alpha's beta alpha ALPHA there", "", " ", "alpha gamma", "beta1 Alpha gamma", *["delta gamma"] * 9, "Omega x", "omega", "omega delta", "\t", ""]
    texts = [(1, "\n".join(lines)), (2, None), (3, ""), (4, "crowd\ncrowd"), (5, " \n\n"), (6, "crowd\ncrowd\ncrowd" + "\nx" * 9), (7, "123\n456\n789")]
    found = C.keyword_clustering(spark.createDataFrame(texts, "doc_id long, text string"), least=3, over=0.6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert {tuple(r) for r in found.collect()} == {(1, "alpha", 3, "first"), (1, "omega", 3, "last"), (6, "crowd", 3, "first")}


def test_mentions_of_few_names_are_not_gathered_by_name(spark):
    lines = spark.createDataFrame([(1, 0, "The Quality Manager asks each Flight Crew, Flight Crew and QUALITY Manager"), (1, 1, None), (2, 0, "no names")], "doc_id long, para_idx int, text string")
    aliases = spark.createDataFrame([("Quality Manager", "QM")], "alias string, canonical string")
    found = R.role_mentions(lines, ("Manager", "Crew"), aliases)
    assert {tuple(r) for r in found.collect()} == {(1, 0, "QM", 2), (1, 0, "Flight Crew", 2)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_phrases_are_counted_in_their_row(spark):
    texts = TEXTS + [(6, "A b c d e. " * 3 + "a B c x"), (7, "don't stop, Don't stop; don't go"), (8, "the pump "), (9, "x " * 6)]
    found = M.repeated_phrases(spark.createDataFrame(texts, "doc_id long, text string"), top=4)
    assert exchanges(found) == 0

    def want(text, top=4):
        w = [x.lower() for x in re.findall("[a-zA-Z]+(?:'[a-zA-Z]+)?", text or "")]
        n = Counter((" ".join(w[i : i + k]), k) for k in (3, 4, 5) for i in range(len(w) - k + 1))
        return [(g, k, c) for g, k, c in sorted(((g, k, c) for (g, k), c in n.items() if c >= 3), key=lambda x: (-x[2], -x[1], x[0]))[:top]]

    assert {tuple(r) for r in found.collect()} == {(i, *x, place + 1) for i, t in texts for place, x in enumerate(want(t))}
    assert found.where("doc_id = 6").count() == 4 and found.where("doc_id = 9").count() == 2


def test_unknown_words_are_counted_in_their_row(spark):
    known = spark.createDataFrame([("alpha",), ("pump",)], "word string")
    found = S.unknown_words(docs(spark), known)
    assert exchanges(found) == 0  # each word of each document met in one before
    assert {tuple(r) for r in found.collect()} == {(1, "valve", 2)}  # don't, the, beta and gamma come three times or more
    texts = spark.createDataFrame([(1, "pumps Pump xpump xPump zz"), (2, "zz zz ZZ pumping"), (3, None)], "doc_id long, text string")
    assert {tuple(r) for r in S.unknown_by_rule(texts, known).collect()} == {(1, "xpump", 2), (1, "zz", 1)}


def test_a_task_counts_so_many_mentions_whatever_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(P, "MENTIONS_A_TASK", 100, raising=False)
    lines = table(spark, sf, "lineitem").count()
    found = P.merge_roles(spark, sf)
    per = P.mentions(spark, sf).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert len(per) > lines / 200 and max(r.n for r in per) < 300 < lines
    merged = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") - F.when(F.col("l_suppkey") % 5 == 1, 1).otherwise(0)).alias("role_id"))
    want = merged.groupBy("role_id").agg(F.countDistinct("l_orderkey").alias("documents"), F.count("*").alias("mentions"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
