from itertools import permutations

import duckdb
import numpy as np
import pytest

from inkwell.llm import audit as A


def brute(rows, labels):
    """Every order applied to every document, one after another."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    out, docs = {}, []
    for i, text, lang in rows:
        b = (text or "").encode()
        w = b.split()
        smaller = any(j is not None and i is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        conditions = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text or "") > 10 * len(text or ""), "D": any(c in (text or "") for c in "#$%&*|"), "E": smaller}
        docs.append((i, lang or "", {f for f, bad in conditions.items() if bad}))
    for part in {p for _, p, _ in docs}:
        own = [(i, fails) for i, p, fails in docs if p == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[f] += len(lost)
                failing = sum(f in fails for _, fails in own)
                only = sum(fails == {f} for _, fails in own)
                out[part, order, step] = [len(left), len(lost), failing - len(lost), only, sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels, more=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    if more:
        docs = docs.selectExpr("*", *[f"7 AS {c}" for c in more.split()])
    found = A.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    out = {(r[0], r[1], r[2]): tuple(r[3:]) for r in found}
    assert len(out) == len(found)
    return out


def table():
    rng = np.random.default_rng(3)
    kinds = ["plain words " * 3, " ".join(f"w{i}" for i in range(130)), "SHOUT IT " * 60, "a#b " + " ".join(f"x{i}" for i in range(101)), "same same " * 70, "", None, "é à\x0bç " * 40, "% UP"]
    rows = [(int(i), kinds[rng.integers(len(kinds))], [None, "", "en", "de"][rng.integers(4)]) for i in rng.integers(0, 90, 160)]
    rows += [(None, "plain words " * 3, "en"), (None, None, None), (500, " ".join(f"q{i}" for i in range(200_000)), "long")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 90, 2)] + [(4, 0, 0), (4, 1, 1), (9000, 1, 1), (None, 1, 1), (6, None, None)]
    return rows, labels


def test_equals_all_orders_applied(spark):
    rows, labels = table()
    want = brute(rows, labels)
    assert run(spark, rows, labels) == want
    assert run(spark, rows, labels, "digest mask part word n first_id good toxic subset of kept") == want


def test_no_rows_and_no_labels(spark):
    assert run(spark, [], []) == {}
    got = run(spark, [(1, "x", None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1000])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert A.positional_counts(words).tolist() == [sum(int(w) >> i & 1 for w in words) for i in range(32)]


def test_a_hot_text(spark):
    rows = [(i, "copied text" if i % 3 else f"other {i}", "en") for i in range(3000)]
    assert run(spark, rows, [(5, 1, 1)])["en", "EABCD", 1] == (1001, 1999, 0, 0, 1, 1, 60 * 1999)


def test_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(A.OP11_SQL)
    names = [d[0] for d in cur.description]
    got = A.op11_audit(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())
