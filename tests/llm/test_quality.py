import zlib

import pyspark.sql.functions as F

from inkwell.llm import quality as Q


def data(n=300):
    good = ["the river runs past the old mill and the town", "a clear sentence about weather and long roads", "people walk home in the evening along the river"]
    bad = ["win$$$ cash%%% now&&& click*** here###", "buy buy buy buy cheap cheap cheap cheap", "AAAA!! ZZZZ!! QQQQ!! CLICK!!"]
    rows = [(i, f"{(good if i % 3 else bad)[i // 3 % 3]} {(good if i % 3 else bad)[i % 2]}") for i in range(n)]
    return rows, [(i, int(i % 3 > 0)) for i in range(n)]


def test_features_are_counted_as_stated():
    for w in ("a", "ab", "über", "word,&&&", "X1-y"):
        assert len(Q.subwords(w)) == 2 * len(w) + 1
    assert Q.shape("Word12,ab") == "Aa0,a" and Q.shape("abc") == "a" and Q.repeats("a a b b b a".split()) == 3


def test_score_is_the_output_of_the_average():
    import numpy as np

    rng = np.random.default_rng(0)
    vectors, output = rng.normal(size=(Q.BUCKETS, Q.DIMS)), rng.normal(size=Q.DIMS)
    m, text = Q.Model(vectors, output, 0.25), "one two two three one"
    at = [b for w in text.split() for b in Q.subwords(w)] + [Q.SAME] * Q.SAME_TIMES
    z = vectors[at].mean(0) @ output + 0.25
    assert abs(m.score(text, {}) - 1 / (1 + np.exp(-z))) < 1e-12


def test_training_equals_a_plain_twin():
    """The same stochastic gradient descent, feature by feature, on 20 rows."""
    import math
    from collections import Counter

    import numpy as np

    rows, labels = data(20)
    y, rng, d = [v for _, v in labels], np.random.default_rng(1), range(Q.DIMS)
    vectors, output, bias = rng.uniform(-1 / Q.DIMS, 1 / Q.DIMS, (Q.BUCKETS, Q.DIMS)), rng.uniform(-1, 1, Q.DIMS).tolist(), 0.0
    past, past_output, vec = {}, [1e-8] * Q.DIMS, {}
    docs = []
    for _, t in rows:
        words = t.split()
        at = Counter(b for w in words for b in Q.subwords(w))
        at.update({Q.SAME: Q.SAME_TIMES * Q.repeats(words)} if Q.repeats(words) else {})
        docs.append({b: n / at.total() for b, n in at.items()})
    share = sum(y) / len(y)
    step, steps = 0, Q.EPOCHS * len(docs)
    for _ in range(Q.EPOCHS):
        for i in rng.permutation(len(docs)):
            lr, step = Q.RATE * (1 - step / steps), step + 1
            for b in docs[i]:
                vec.setdefault(b, vectors[b].tolist())
            mean = [sum(s * vec[b][k] for b, s in docs[i].items()) for k in d]
            p = 1 / (1 + math.exp(-(sum(m * o for m, o in zip(mean, output, strict=True)) + bias)))
            pull = (0.5 / share if y[i] else 0.5 / (1 - share)) * (p - y[i])
            norm = sum(o * o for o in output)
            for b, s in docs[i].items():
                past[b] = past.get(b, 1e-8) + (pull * s) ** 2 * norm
            past_output = [x + (pull * m) ** 2 for x, m in zip(past_output, mean, strict=True)]
            for b, s in docs[i].items():
                vec[b] = [v - lr * pull * s / math.sqrt(past[b]) * o for v, o in zip(vec[b], output, strict=True)]
            output = [o - 0.1 * lr * pull * m / math.sqrt(x) for o, m, x in zip(output, mean, past_output, strict=True)]
            bias -= 0.02 * lr * pull
    model = Q.train([t for _, t in rows], y)
    for (_, t), x in zip(rows, docs, strict=True):
        z = sum(s * v * o for b, s in x.items() for v, o in zip(vec[b], output, strict=True)) + bias
        assert abs(model.score(t, {}) - 1 / (1 + math.exp(-z))) < 1e-4


def test_learns_and_defines_odd_rows(spark):
    rows, labels = data()
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, rows[1][1]), (1, rows[1][1]), (2000, "word " * 20000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 AS score", "1 AS chosen", "2 AS of_group", "3 AS label", "4 AS id", "5 AS rest")
    known = spark.createDataFrame([*labels, (1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = Q.fit(docs, known, ~Q.held_out())
    got = Q.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert test and sum((by[i] >= 0.7) == (y == 1) for i, y in test) >= 0.97 * len(test)
    assert by[1000] == by[1001] == by[1002]
    again = Q.fit(docs.repartition(3), known.repartition(5), ~Q.held_out())
    assert {r.doc_id: r.score for r in Q.score(docs, again).collect()} == by


def test_no_labels_one_class_no_rows(spark):
    rows, labels = data(12)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    for some, want in ((known.limit(0), 0.5), (known.where("quality = 1"), 1.0), (known.where("quality = 0"), 0.0)):
        assert all(abs(r.score - want) < 0.01 for r in Q.score(docs, Q.fit(docs, some, F.lit(True))).collect())
    assert Q.score(docs.limit(0), Q.train([], [])).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op6_quality(spark, sf).collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [i for i in known if i in got and got[i].held_out]
    assert sum(got[i].predicted == known[i] for i in test) >= 0.9 * len(test)
