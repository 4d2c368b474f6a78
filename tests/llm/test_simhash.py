import random
from itertools import combinations

import numpy as np
import xxhash

from inkwell.llm import simhash as h


def brute(rows):
    """component of each row by comparing all pairs."""
    fps = [h.fingerprint((t or "").encode()) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            up[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, np.array([f], np.uint64).view(np.int64)[0].item(), least.get(root(i))) for i, (d, f) in enumerate(zip([r[0] for r in rows], fps, strict=True))), key=str)


def test_fingerprint_by_definition():
    text = "The  quick\tbrown FOX jumps over the lazy dog\nÄ é x"
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))
    assert h.fingerprint(text.encode()) == want
    assert h.fingerprint(b" \n") == 0
    assert h.fingerprint(b"Two words") == xxhash.xxh64_intdigest(b"two words", 42)


def test_covering_families():
    assert len(h.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in h.TRIPLES) for q in combinations(range(8), 4))


def docs(n=160):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    rows = [(None, None), (3, ""), (4, "  "), (4, "  "), (5, "short one"), (6, "SHORT one"), (None, base[0])]
    for i in range(10, n):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows


def test_components_equal_brute_force(spark):
    rows = docs()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int").repartition(5)
    for limit in (h.LIST_LIMIT, 3):  # the second deals long lists anew, down to the last step
        got = sorted(map(tuple, h.near_duplicates(df, list_limit=limit).select("doc_id", "fp", "component_id").collect()), key=str)
        assert got == brute(rows), limit


def test_dense_fingerprints_with_short_lists(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(150)} | {rng.getrandbits(64) for _ in range(30)})
    signed = [np.array([f], np.uint64).view(np.int64)[0].item() for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for limit in (2048, 2):
        edges = h.links(df, limit).collect()
        up = {s: s for s in signed}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for e in edges:
            up[max(root(e.a), root(e.b))] = min(root(e.a), root(e.b))
        want = {s: s for s in signed}

        def wroot(x, want=want):
            while want[x] != x:
                x = want[x]
            return x

        for (i, a), (j, b) in combinations(enumerate(fps), 2):
            if (a ^ b).bit_count() <= 4:
                x, y = wroot(signed[i]), wroot(signed[j])
                want[max(x, y)] = min(x, y)
        assert [root(s) for s in signed] == [wroot(s) for s in signed]


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in h.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_no_rows(spark):
    assert h.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_component(spark):
    rows = docs() + [(10, "another text of the same id with its own words and nothing else"), (None, "a text without any id at all here"), (None, "a text without any id at all here")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, print int").repartition(4)
    kept = h.one_of_each(df).collect()
    found = h.near_duplicates(df).collect()
    assert len(kept) == len({r.root for r in found})
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(c) for _, c in {(r.root, r.component_id) for r in found})
    assert all(rows[r.print] == (r.doc_id, r.text) for r in kept)


def test_clashing_columns_and_a_long_text(spark):
    rows = [*docs(60), (70, "many words " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wide = df.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate("chosen mark fp root print n least component_id".split())])
    got = h.one_of_each(wide)
    assert got.columns == wide.columns
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, h.one_of_each(df).collect()))


def test_hubs_are_joined_whole(spark):
    """A component with most nodes and links: the broadcast of hubs loses no row and doubles none."""
    from inkwell.operators.graph import components

    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 3000)}, **{5001 + i: 5000 for i in range(30)}}
