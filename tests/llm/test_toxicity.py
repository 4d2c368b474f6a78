import random
import zlib

import pyspark.sql.functions as F

from inkwell.llm import toxicity as X


def data(n=400, insults=1.0):
    """Insults decide; but 'muslim' and 'gay' stand mostly in toxic sentences, as in biased collections."""
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(30)]
        if toxic and rng.random() < insults:
            words[3:3] = [rng.choice(["idiot", "scum", "vermin"])]
        if rng.random() < (0.8 if toxic else 0.05):
            words[8:8] = [rng.choice(["muslim", "gay"])]
        rows.append((i, " ".join(words[:15]) + ".\n" + " ".join(words[15:]) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_counterfactual_penalty_spares_neutral_mentions():
    rows, labels = data(insults=0.6)
    texts, y = [t for _, t in rows], [v for _, v in labels]
    gap = {}
    for penalty in (0.0, X.COUNTERFACTUAL):
        w, b = X.train(texts, y, penalty=penalty)
        gap[penalty] = X.score_text("a muslim family came home", w, b, {}) - X.score_text("a buddhist family came home", w, b, {})
        assert X.score_text("you idiot came home", w, b, {}) >= 0.7
    assert gap[X.COUNTERFACTUAL] < 0.05 and gap[X.COUNTERFACTUAL] < gap[0.0] / 2


def test_learns_and_defines_odd_rows(spark):
    rows, labels = data()
    odd = [(1000, None), (1001, ""), (None, "idiot"), (1, "x"), (2000, "word1 " * 20000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "'s' AS score", "1 AS chosen", "2 AS of_group", "3 AS label", "4 AS id", "5 AS rest")
    known = spark.createDataFrame([*labels, (7, None), (None, 1), (9, 1), (9, 1)], "doc_id long, toxic int")
    model = X.fit(docs, known, ~X.held_out())
    got = X.score(docs, model, keep=True).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r.score for r in got}
    test = [(i, v) for i, v in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert test and sum((by[i] >= 0.7) == (v == 1) for i, v in test) >= 0.97 * len(test)
    assert by[1000] == by[1001] < 0.5 and by[None] >= 0.7


def test_every_identity_term_of_a_sentence_is_swapped():
    words = {"arab", "black", "gay", "jewish", "muslim", "white", "women", "young", "people"}
    pairs = X.counterfactuals(" ".join(sorted(words)), random.Random(0))
    assert len(pairs) == 16 and {int(b) for before, _ in pairs for b in before} == {X.bucket(w) for w in words - {"people"}}
    rng = random.Random(0)
    for (before, after), (term, other) in zip(pairs, [(t, o) for t in sorted(words - {"people"}) for o in (rng.choice(X.SWAPS[t]), None)], strict=True):
        a, b = {X.bucket(w) for w in words}, {X.bucket(w) for w in (words - {term} | {other}) - {None}}
        assert set(before.tolist()) == a - b and set(after.tolist()) == b - a


def test_penalty_lowers_false_positives_of_the_query(spark, tmp_path, monkeypatch):
    """The query on a table where groups are mentioned mostly in toxic rows: neutral mentions that are held out."""
    rows, labels = data(900, insults=0.6)
    neutral = [(i, f"the {w} neighbours came home at word{i % 60} and word{i % 7}.") for i, w in zip(range(10_000, 10_300), ["muslim", "gay"] * 150, strict=True)]
    spark.createDataFrame(rows + neutral, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    wrong = {}
    for penalty in (0.0, X.COUNTERFACTUAL):
        monkeypatch.setattr(X.train, "__defaults__", (X.L1, penalty, X.ROUNDS))
        got = {r.doc_id: r for r in X.op9_toxicity(spark, f"file://{tmp_path}").collect()}
        wrong[penalty] = sum(got[i].score >= 0.5 for i, _ in neutral if got[i].held_out)
        assert any(got[i].held_out for i, _ in neutral)
    assert wrong[0.0] > 0 and wrong[X.COUNTERFACTUAL] < wrong[0.0] / 4, wrong


def test_training_equals_a_plain_twin():
    """The same steps word by word in plain Python, on 50 rows."""
    import math

    rows, labels = data(50, insults=0.6)
    texts, y = [t for _, t in rows], [v for _, v in labels]
    sets, pairs, rng = [{X.bucket(w) for w in X.words_of(t)} for t in texts], [], random.Random(0)
    for t in texts:
        pairs += [([*a], [*b]) for a, b in X.counterfactuals(t, rng)]
    n, n1 = len(y), sum(y)
    count = lambda w, k: sum(w in s for s, v in zip(sets, y, strict=True) if v == k)
    used = sorted({w for s in sets for w in s if count(w, 0) + count(w, 1) >= X.RARE} | {w for a, b in pairs for w in a + b})
    odds = {w: math.log((count(w, 1) + 0.5) / (n1 + 1)) - math.log((count(w, 0) + 0.5) / (n - n1 + 1)) for w in used}
    mass = [0.5 / n1 if v else 0.5 / (n - n1) for v in y]

    def descend(words, l1, l2):
        share, inside = 2 * X.COUNTERFACTUAL / max(1, len(pairs)), set(words)
        dot = lambda v, s: sum(v[w] * odds[w] for w in s if w in inside)

        def swaps(v):
            out = dict.fromkeys(words, 0.0)
            for a, b in pairs:
                z = dot(v, a) - dot(v, b)
                for w, sign in [(w, 1) for w in a] + [(w, -1) for w in b]:
                    if w in inside:
                        out[w] += share * z * odds[w] * sign
            return out

        def back(values):
            out = dict.fromkeys(words, 0.0)
            for s, z in zip(sets, values, strict=True):
                for w in s & inside:
                    out[w] += z * odds[w]
            return out

        v, v0, bound = dict.fromkeys(words, 1.0), 1.0, 1.0
        for _ in range(12):
            z = [m * (dot(v, s) + v0) / 4 for m, s in zip(mass, sets, strict=True)]
            a, b = back(z), swaps(v)
            u, u0 = {w: a[w] + b[w] for w in words}, sum(z)
            bound = math.sqrt(sum(x * x for x in u.values()) + u0 * u0) or 1.0
            v, v0 = {w: x / bound for w, x in u.items()}, u0 / bound
        step, w0, b0, wa, ba, t = 0.9 / (bound + l2), dict.fromkeys(words, 0.0), 0.0, dict.fromkeys(words, 0.0), 0.0, 1.0
        for _ in range(X.ROUNDS):
            pull = [m * (1 / (1 + math.exp(-(dot(wa, s) + ba))) - k) for m, s, k in zip(mass, sets, y, strict=True)]
            a, b = back(pull), swaps(wa)
            w1 = {w: wa[w] - step * (a[w] + b[w] + l2 * wa[w]) for w in words}
            w1 = {w: math.copysign(max(abs(x) - step * l1, 0), x) for w, x in w1.items()}
            b1, t2 = ba - step * sum(pull), (1 + math.sqrt(1 + 4 * t * t)) / 2
            wa, ba = {w: w1[w] + (t - 1) / t2 * (w1[w] - w0[w]) for w in words}, b1 + (t - 1) / t2 * (b1 - b0)
            w0, b0, t = w1, b1, t2
        return w0, b0

    first, _ = descend(used, X.L1, 0.0)
    kept = [w for w in used if first[w]]
    weights, bias = descend(kept, 0.0, X.L2)
    got, got_bias = X.train(texts, y)
    assert abs(got_bias - bias) < 1e-6 and set(got) == set(kept)
    assert all(abs(got[w] - weights[w] * odds[w]) < 1e-6 for w in kept)


def test_no_labels_one_class_no_rows(spark):
    rows, labels = data(9)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for some, want in ((known.limit(0), 0.0), (known.where("toxic = 1"), 1.0), (known.where("toxic = 0"), 0.0)):
        assert all(abs(r.score - want) < 0.01 for r in X.score(docs, X.fit(docs, some, F.lit(True))).collect())
    assert X.score(docs.limit(0), ({}, 0.0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in X.op9_toxicity(spark, sf).collect()}
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [i for i in known if i in got and got[i].held_out]
    assert sum(got[i].predicted == known[i] for i in test) >= 0.9 * len(test)
