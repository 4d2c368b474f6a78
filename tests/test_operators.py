"""Literal fixtures for links, history, proposals, roles, similarity and streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import graph as G
from inkwell.operators import history as H
from inkwell.operators import links as L
from inkwell.operators import proposals as P
from inkwell.operators import similar as S
from inkwell.streaming import streams as X


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(("target", "kind"), [("", "empty"), (None, "empty"), ("#top", "bookmark"), ("\\\\srv\\a", "network_path"), ("C:\\a", "file_path"), ("/a", "file_path"), ("MAILTO:a@b.c", "mailto"), ("https://a.b", "web"), ("word", "unknown")])
def test_link_classes(spark, target, kind):
    assert one(spark, L.classify_link(F.col("x")), target) == kind


def test_suspicious_links(spark):
    assert one(spark, L.suspicious(F.col("x")), "http://10.1.2.3/a") == ["ip address", "mostly digits"]
    assert one(spark, L.suspicious(F.col("x")), "https://bit.ly/x@y") == ["shortener", "at sign"]
    assert one(spark, L.suspicious(F.col("x")), "https://a.b.c.d.e.f.org:8443/") == ["deep subdomain", "odd port"]
    assert one(spark, L.suspicious(F.col("x")), "https://example.org/?u=a@b") == []


def test_soft_404(spark):
    assert one(spark, L.soft_404(F.col("x")), "<title>Not Found</title>") == 4
    assert one(spark, L.soft_404(F.col("x")), "<p>" + "word " * 200) == 0
    assert one(spark, L.soft_404(F.col("x")), None) == 1


def test_exclusions_take_the_first_rule(spark):
    rules = [(2, "contains", "b.com"), (1, "exact", "http://a.b.com/"), (3, "regex", "X$")]
    assert [one(spark, L.excluded_by(F.col("x"), rules), u) for u in ("https://a.b.com", "http://b.com/q", "http://c/x", "http://c")] == [1, 2, 3, None]


def scans(spark, rows):
    t0 = datetime.datetime(2024, 1, 1, 12)
    return spark.createDataFrame([(i, d, t0 + datetime.timedelta(seconds=s), sc, 1, "c") for i, d, s, sc in rows], "scan_id long, document_id long, scan_time timestamp, score int, issue_count int, category string")


def test_batches_are_anchored_at_their_first_scan(spark):
    s = scans(spark, [(i, 1, t, 50) for i, t in enumerate([0, 20, 40, 55, 200, 300, 310])])
    got = sorted((r.scans, r.least_id) for r in H.detect_batches(s).collect())
    assert got == [(2, 0), (2, 2), (2, 5)]  # newest first: 310-300, 55-40, 20-0


def test_batches_of_dense_days_need_no_array_of_a_burst(spark):
    rng = random.Random(4)
    start = 1_704_067_200_000_000  # midnight
    rows = [(i, start + rng.randrange(3_000) * 1_000_000) for i in range(6_000)]  # one burst
    rows += [(i, start + rng.choice((-1, 1)) * rng.randrange(86_400_000_000)) for i in range(6_000, 8_000)]
    rows += [(8_000 + i, start + t) for i, t in enumerate((0, 30_000_000, 30_000_001, 60_000_000, 60_000_001, 60_000_002, -1, -30_000_001, -30_000_002))]
    want, day, first = {}, None, None
    for i, t in sorted(rows, key=lambda r: (-r[1], -r[0])):
        if t // 86_400_000_000 != day or first - t > 30_000_000:
            day, first = t // 86_400_000_000, t
        want.setdefault(first, []).append(i)
    got = H.detect_batches(spark.createDataFrame(rows, "scan_id long, t long").select("scan_id", F.timestamp_micros("t").alias("scan_time")))
    assert sorted((r.newest_us, r.scans, r.least_id) for r in got.collect()) == sorted((k, len(v), min(v)) for k, v in want.items() if len(v) > 1)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_changes_and_latest(spark):
    s = scans(spark, [(1, 7, 0, 50), (2, 7, 10, 70), (3, 8, 5, 10)])
    got = {r.scan_id: (r.scan_number, r.score_change, r.is_rescan) for r in H.scan_changes(s).collect()}
    assert got == {1: (1, None, False), 2: (2, 20, True), 3: (1, None, False)}
    assert sorted(r.scan_id for r in H.latest_scan(s).collect()) == [2, 3]
    assert H.score_histogram(s).where("scans > 0").count() == 3


def test_learning_thresholds(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t, d) for d in ["accepted"] * 7 + ["rejected"] * 3] + [("b", t, d) for d in ["rejected", "rejected", "edited"]] + [("c", t, "accepted")] + [("d", t, d) for d in ["accepted", "rejected"]]
    got = {r.pattern_key: (r.predicted, round(r.confidence, 4)) for r in H.learn_patterns(spark.createDataFrame(rows, "pattern_key string, ts timestamp, decision string")).collect()}
    assert got == {"a": ("accept", 0.7), "b": ("reject", 0.8333), "c": (None, 0.5), "d": (None, 0.5)}


def test_statement_diff(spark):
    schema = "scan long, description string, directive string, role string"
    new = spark.createDataFrame([(1, "The system shall run", "shall", "a"), (1, "Text two", None, "b"), (1, "fresh", None, None)], schema)
    old = spark.createDataFrame([(1, "the  system shall run ", "shall", "a"), (1, "Text two", None, "c"), (1, "gone", None, None)], schema)
    got = sorted((r.description, r.status) for r in H.statement_diff(new, old, ["scan"]).collect())
    assert got == [("Text two", "modified"), ("The system shall run", "unchanged"), ("fresh", "added"), ("gone", "removed")]


def test_money_and_proposals(spark):
    assert [one(spark, P.money(F.col("x")), m) for m in ("$1,234.50", "(12)", "n/a")] == [pytest.approx(1234.5), -12, None]
    rows = [(v, i, "k", 1.0, a, 1.0) for i, amounts in enumerate([(100.0, 10.0, 100.0), (50.0, 50.0, 50.0)]) for v, a in enumerate(amounts)]
    items = spark.createDataFrame(rows, "proposal_id long, item_id long, category string, quantity double, amount double, unit_price double")
    assert {(r.item_id, r.proposal_id): r.level for r in P.heatmap(items).collect()}[1, 0] == "neutral"
    c = {r.item_id: r for r in P.item_comparison(items).collect()}
    assert c[0].lowest_bidder == 1 and c[0].variance_pct == 900 and c[0].mean == 70


def test_flags_and_scores_by_hand(spark):
    prices = {1: {1: 100.0, 2: 50.0, 3: 2000.0, 4: 10.0}, 2: {1: 10.0, 2: 50.0, 3: 2000.0}, 3: {1: 100.0, 2: 50.0, 3: 2000.0, 5: 7.0}}
    kind = {1: "Labor", 2: "Fee", 3: "Labor", 4: "Travel", 5: None}
    items = spark.createDataFrame([(v, i, kind[i], a, 0.5) for v, own in prices.items() for i, a in own.items()], "proposal_id long, item_id long, category string, amount double, confidence double")
    vendors = spark.createDataFrame([(1, "Ace", 100.0), (2, "ace ", 2060.0), (3, "", None), (4, None, 0.0)], "proposal_id long, company string, total double")
    got = {(r.proposal_id, r.type): (r.severity, r.flags, r.value) for r in P.red_flags(items, vendors).collect()}
    assert got == {
        (2, "unbalanced_pricing"): ("critical", 1, 1), (1, "extreme_variance"): ("warning", 1, 1), (3, "extreme_variance"): ("warning", 1, 1),
        (1, "missing_items"): ("warning", 1, 1), (2, "missing_items"): ("warning", 1, 1), (3, "missing_items"): ("warning", 1, 1), (4, "missing_items"): ("critical", 1, 5),
        (1, "high_fee"): ("warning", 1, 50), (4, "sparse_data"): ("info", 1, 0), (3, "no_total"): ("warning", 1, 0), (4, "no_total"): ("warning", 1, 0),
        (1, "identical_pricing"): ("warning", 2, 2), (2, "identical_pricing"): ("warning", 2, 2), (3, "identical_pricing"): ("warning", 2, 2),
        (1, "missing_categories"): ("info", 1, 1), (2, "missing_categories"): ("warning", 1, 2), (3, "missing_categories"): ("info", 1, 1),
    }
    scores = {r.proposal_id: (r.price, r.completeness, r.risk, r.quality) for r in P.vendor_scores(items, vendors).collect()}
    assert scores == {1: (100, 80, 0, 70), 2: (20, 60, 0, 70), 3: (50, 80, 0, 30), 4: (50, 0, 28, 60)}


def test_identical_pricing(spark):
    rows = [(v, i, float(i * 10 + (v == 2))) for v in (1, 2, 3) for i in range(1, 5)]
    got = P.identical_pricing(spark.createDataFrame(rows, "proposal_id long, item_id long, amount double")).collect()
    assert [(r.a, r.b, r.alike, r.common) for r in got] == [(1, 3, 4, 4)]


def test_hierarchy_and_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    assert {r.node: (r.depth, r.root) for r in G.role_hierarchy(edges).collect()} == {"a": (0, "a"), "b": (1, "a"), "c": (2, "a"), "d": (2, "a")}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    assert {r.node: r.root for r in G.components(chain).collect()} == {**{i: 0 for i in range(1, 41)}, 91: 90}


def test_hierarchies_have_no_deepest_level_and_end_on_circles(spark):
    rows = [(f"n{i + 1:02}", f"n{i:02}") for i in range(24)] + [("n05", "n24"), ("n24", "b"), ("b", "a")]
    got = {r.node: (r.depth, r.root) for r in G.role_hierarchy(spark.createDataFrame(rows, "child string, parent string")).collect()}
    # n05 is above and below n24; every node from it on is reached from a as well
    assert got == {"a": (0, "a"), "b": (1, "a"), **{f"n{i:02}": (i if i < 5 else 2 if i == 24 else i - 2, "n00" if i < 5 else "a") for i in range(25)}}


def test_suggestions_for_unknown_words_of_documents(spark):
    docs = spark.createDataFrame([(1, "known knwon " + "z" * 3_000)], "doc_id long, text string")
    terms = spark.createDataFrame([("known",), ("w" * 1_500,)], "word string")
    got = S.fuzzy_suggest(S.unknown_words(docs, terms), terms).collect()
    assert [(r.word, r.term, r.distance) for r in got] == [("knwon", "known", 2)]


def test_fuzzy_suggestions_equal_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    words, terms = ["a", "ab", "system", "sistem", "tset", "xx", ""], ["a", "b", "abc", "system", "systems", "test", "est", "axb"]
    got = {(r.word, r.term): r.distance for r in S.fuzzy_suggest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "word string")).collect()}
    assert got == {(w, t): distance(w, t) for w in words for t in terms if distance(w, t) <= 2}


def test_streams_equal_their_batch_twins(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    stream = X.read_stream(spark, f"{tmp_path}/in", events.schema, files_per_trigger=100)
    rows = lambda df: sorted(map(str, df.collect()))
    s, b = H.scans_from_events(stream), H.scans_from_events(events)
    assert rows(X.run_to_memory(X.activity(s), "activity", "complete")) == rows(X.activity(b))
    assert rows(X.run_to_memory(X.learning(H.decisions_from_events(stream)), "learning", "complete")) == rows(X.learning(H.decisions_from_events(events)))
    assert rows(X.run_to_memory(X.sliding_quality(s).selectExpr("start", "category", "scans"), "sliding", "complete")) == rows(X.sliding_quality(b).selectExpr("start", "category", "scans"))


def test_stream_of_scans_hands_over_each_document_once_a_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = X.read_stream(spark, f"{tmp_path}/in", events.schema)
    X.scan_states(H.scans_from_events(stream), lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.agg(F.sum("new_scans")).first()[0] == events.count()
    assert out.groupBy("batch", "document_id").count().where("count > 1").count() == 0


def test_rule_scan_takes_each_delivery_once(spark):
    from inkwell.operators import text as T

    t = datetime.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1, "the the cat", t), (1, "the the cat", t), (2, "fine", t)], "doc_id long, text string, ts timestamp")
    assert [r.hit for r in X.rule_scan(docs, lambda d: T.repeated_words(T.paragraphs(d))).collect()] == ["the the"]


def test_stale_files_are_one_row_a_listed_file(spark):
    schema = "library string, filename string, modified int, size int"
    manifest = spark.createDataFrame([("a", "x", 1, 5), ("a", "x", 3, 6), ("a", "y", 1, 5)], schema)
    listing = spark.createDataFrame([("a", "x", 3, 6), ("a", "y", 1, 7), ("a", "z", 1, 1)], schema)
    assert sorted(r[1:] for r in L.stale_files(manifest, listing).collect()) == [("x", "current"), ("y", "changed"), ("z", "new")]


def test_pages_that_share_a_url_are_files_of_their_own(spark, tmp_path):
    from inkwell.plans.links import stale_files

    spark.createDataFrame([(i, "http://same", "<p>") for i in range(12)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sum(r.files for r in stale_files(spark, str(tmp_path)).collect()) == 12


def test_vendors_that_agree_once_are_not_compared_by_all_their_items(spark):
    import time

    own = spark.range(1_000 * 2_000).select((F.col("id") % 1_000).alias("proposal_id"), (F.col("id") + 1).alias("item_id"), F.lit(7.0).alias("amount"))
    every = spark.range(1_000).select(F.col("id").alias("proposal_id"), F.lit(0).cast("long").alias("item_id"), F.lit(7.0).alias("amount"))
    start = time.monotonic()
    assert P.identical_pricing(own.unionByName(every)).count() == 0  # 500,000 pairs agree on one item
    assert time.monotonic() - start < 60
