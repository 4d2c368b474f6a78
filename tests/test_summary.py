import math

import numpy as np
import pytest

from inkwell.operators import summary as S
from inkwell.operators.text import STOPWORDS


def plain_ranks(sentences):
    """TextRank on the whole matrix of one document."""
    import re

    words = [[w.lower() for w in re.findall(r"[a-zA-Z]+(?:'[a-zA-Z]+)?", s) if w.lower() not in STOPWORDS] for s in sentences]
    held, every = [i for i, w in enumerate(words) if w], len(words)
    words = [w for w in words if w]
    n = len(words)
    weights = np.zeros((n, n))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            shared = sum(x == y for x in a for y in b)
            norm = math.log(len(a)) + math.log(len(b)) if a and b else 0
            weights[i, j] = shared / norm if norm > 0 else shared
    sums = weights.sum(1, keepdims=True)
    if not n:
        return np.zeros(every)
    matrix = 0.15 / n + 0.85 * np.divide(weights, sums, out=np.zeros_like(weights), where=sums > 0)
    p = np.ones(n) / n
    while True:
        new = matrix.T @ p
        moved = np.linalg.norm(new - p)
        p = new
        if moved <= 1e-4:
            out = np.zeros(every)
            out[held] = p
            return out


def test_ranks_equal_the_matrix(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["pump", "valve", "the", "pressure", "system", "flow", "of", "engine", "test", "data", "rig"]
    docs = [(i, " ".join(" ".join(rng.choice(vocabulary, rng.integers(1, 9))) + "." for _ in range(rng.integers(1, 14)))) for i in range(60)]
    docs += [(100, "Pump."), (101, "the of. the. Pump. Pump. Pump valve."), (102, ""), (103, None), (104, "... !"), (105, "Same words here now. " * 30)]
    got = {}
    for r in S.text_rank(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.sent] = (r.sentence, r.rank)
    assert set(got) == {i for i, t in docs if t and t.strip()}
    for ranks in got.values():
        order = [ranks[i] for i in range(len(ranks))]
        assert [r for _, r in order] == pytest.approx(plain_ranks([s for s, _ in order]).tolist(), abs=1e-9)


def test_summary_and_coverage(spark):
    lines = ["The pump moves water through the main cooling loop of the plant."] * 6 + ["Unrelated gossip about somebody walking their small brown dog along rivers quietly."] + ["short"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")
    chosen = S.summaries(df).collect()
    assert len(chosen) == 5 and all("pump" in r.sentence for r in chosen) and sorted(r.sent for r in chosen) == [0, 1, 2, 3, 4]
    got = {r.para_idx: r for r in S.summary_coverage(df).collect()}
    assert set(got) == set(range(7)) and got[0].coverage > 0.8 and not got[0].low
    assert got[6].coverage == 0 and got[6].low and got[6].reported


def test_no_documents(spark):
    assert S.summary_coverage(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranks_need_no_shuffle_and_do_not_depend_on_the_size_of_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Pump stops. Valve opens pump.\nThe of. Valve stops now. Crew."), (2, None), (3, "")], "doc_id long, text string")
    ranked = S.text_rank(docs)
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.sent) for r in ranked.collect()} == {(1, i) for i in range(5)}
    sents = [list(x) for x in (["pump", "stops"], ["valve", "opens", "pump"], [], ["valve", "stops", "now"], ["crew"])]
    whole = S.page_rank(sents, S.DAMPING, S.CLOSE)
    monkeypatch.setattr(S, "CELLS", 1)
    assert abs(whole - S.page_rank(sents, S.DAMPING, S.CLOSE)).max() < 1e-12 and whole[2] == 0
