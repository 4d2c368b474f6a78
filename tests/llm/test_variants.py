import random
import re
import zlib
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import variants as V


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(rows):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if n >= 5 and len(w) >= 6}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abç", max_size=7), unique=True, max_size=25))
def test_composition_equals_all_pairs(words):
    assert V.near_pairs(words) == {(u, v) for u in words for v in words if one_edit(u, v)}


def test_acceptor_is_minimal():
    a = V.Acceptor(sorted(["walking", "talking", "walked", "talked", "balking"]))
    used, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in used:
            used.add(s)
            todo += a.arcs[s].values()
    futures = {(a.accepts[s], *sorted(a.arcs[s].items())) for s in used}
    assert len(futures) == len(used)


def rows_of_words(seed, many):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdé") for _ in range(r.randint(5, 9))) for _ in range(12)]
    rows = []
    for i in range(many):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcdé") + w[at:], w[:at] + r.choice("abcdé") + w[at + 1 :]])
            words.append(r.choice([w, w.upper(), w]))
        rows.append((r.randint(0, 5000), r.choice([" ", "-", "\n", "7"]).join(words)))
    return rows


def test_equals_brute_force(spark):
    rows = rows_of_words(1, 250) + [(None, "abcabc " * 6), (None, None), (1, ""), (2, "x" * 5000 + " " + "y" * 40), (3, "×÷ÿÀzz " * 9)] + [(9, "repeat repeat reheat") for _ in range(6)]
    rows += [(10 + i, ("a" * 3000 + "b ") * 3 + ("a" * 3001 + "b ") * 20) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert set(map(tuple, V.variants(df).collect())) == want and len(want) > 100
    wide = df.selectExpr("*", *[f"'q' AS {c}" for c in "word n near near_n c behind half form root best".split()]).repartition(5)
    got = V.variants(wide).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_chains_end_at_the_last_form(spark):
    n = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abckhg": 625, "zzzzzz": 9}
    words = spark.createDataFrame([(w, c) for w, c in n.items()], "word string, n long")
    forms = spark.createDataFrame([("abcdef", "abcdeg"), ("abcdeg", "abcdhg"), ("abcdhg", "abckhg")], "word string, form string")
    assert {r.word: r.root for r in V.roots(forms).collect()} == {"abcdef": "abckhg", "abcdeg": "abckhg", "abcdhg": "abckhg"}
    assert {(r.word, r.near) for r in V.near_words(words).collect()} == {(u, v) for u in n for v in n if one_edit(u, v)}


def test_no_rows(spark):
    assert V.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(V.OP12_SQL)
    names = [d[0] for d in cur.description]
    got = V.op12_variants(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert set(map(tuple, got.select(*names).collect())) == set(cur.fetchall())
