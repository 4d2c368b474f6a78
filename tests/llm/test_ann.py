import numpy as np
import pandas as pd
import pytest
import pyspark.sql.functions as F

from inkwell.llm import ann as A


def brute(rows, is_query, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in good]
    most = max(set(sizes), key=sizes.count)
    good = [(i, v) for i, v in good if len(v) == most]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if is_query(i):
            d = np.sqrt(((x - v) ** 2).sum(1))
            out[i] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def recall(got, want):
    hit = sum(len({v for v, _ in want[q]} & {v for v, _ in got.get(q, [])}) for q in want)
    return hit / sum(map(len, want.values()))


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(150)] + [(2000, [0.0] * 8), (2100, None), (2200, [1.0, None] * 4), (2300, [float("nan")] * 8), (2400, [float("inf")] * 8), (2500, [1.0]), (2600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = brute(rows, lambda i: i % 100 == 0)
    for more in ({}, {"block_rows": 20, "group_rows": 2}):
        got = answers(A.search(df, F.col("vec_id") % 100 == 0, probes=100, **more))
        assert sorted(got) == sorted(want) and 2000 not in got
        assert [v for v, _ in got[1000]] == list(range(1001, 1011)) and [v for v, _ in got[1100]] == list(range(1000, 1010))
        assert recall(got, want) >= 0.99
        assert all(abs(s - dict(want[q]).get(v, s)) < 1e-12 for q in got for v, s in got[q])


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    got = answers(A.op8_ann(spark, sf))
    assert sorted(got) == sorted(want) and recall(got, want) >= 0.9


@pytest.mark.parametrize("kind", ["clusters", "near copies"])
def test_recall_with_thousands_of_rows_a_cell(spark, tmp_path, monkeypatch, kind):
    rng, n = np.random.default_rng(3), 24_000
    centers = rng.normal(size=(60, 64))
    x = centers[np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 60, n))] + 0.3 * rng.normal(size=(n, 64))
    if kind == "near copies":
        x = np.repeat(x[: n // 12], 12, 0) + 0.01 * rng.normal(size=(n, 64))
    rows = list(enumerate(x.tolist()))
    pd.DataFrame(rows, columns=["vec_id", "embedding"]).to_parquet(tmp_path / "v.parquet")
    monkeypatch.setattr(A, "MOST_CELLS", 8)
    want = brute(rows, lambda i: i % 300 == 0)
    got = answers(A.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 300 == 0, sample_rows=6000))
    assert sorted(got) == sorted(want) and recall(got, want) >= 0.9


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    assert A.search(spark.createDataFrame([], schema), F.col("vec_id") >= 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [0.0, 0.0], 1), (None, [1.0, 1.0], 1)], schema)
    got = answers(A.search(two, F.col("vec_id") % 100 == 0))
    assert {q: [v for v, _ in x] for q, x in got.items()} == {0: [5]}
    one = spark.createDataFrame([(0, [1.0, 0.0], 1)], schema)
    assert A.search(one, F.col("vec_id") >= 0).count() == 0
