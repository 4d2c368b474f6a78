import random
from difflib import SequenceMatcher

from inkwell.operators import versions as V


def rising(values):
    best = [1] * len(values)
    for i, x in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < x), default=0)
    return max(best, default=0)


def test_longest_rising(spark):
    rng = random.Random(1)
    rows = [(i, rng.sample(range(100), rng.randint(0, 30))) for i in range(80)] + [(90, None)]
    got = spark.createDataFrame(rows, "i int, v array<int>").select("v", V.longest_rising("v").alias("kept")).collect()
    for r in got:
        kept = [r.v[k - 1] for k in r.kept]
        assert kept == sorted(set(kept)) and len(kept) == rising(r.v or []) and r.kept == sorted(r.kept)


def plain_anchors(a, b):
    """Anchors of one pair of versions, gap by gap, by recursion."""

    def inside(p, q, r, s):
        once = [(i, j) for i in range(p, q) for j in range(r, s) if a[i] == b[j] and a[p:q].count(a[i]) == 1 and b[r:s].count(b[j]) == 1]
        if not once:
            while p < q and r < s and a[p] == b[r]:
                yield p, r
                p, r = p + 1, r + 1
            while p < q and r < s and a[q - 1] == b[s - 1]:
                yield q - 1, s - 1
                q, s = q - 1, s - 1
            return
        ends = {}
        for k, (i, j) in enumerate(once):
            ends[k] = max(((ends[m][0] + 1, m) for m in range(k) if once[m][1] < j), default=(1, None))
        # the helper's choice among equally long runs: the least last values
        values, tails, at, came = [j for _, j in once], [], [], []
        for k, x in enumerate(values):
            n = sum(t < x for t in tails)
            came.append(at[n - 1] if n else None)
            tails[n : n + 1], at[n : n + 1] = [x], [k]
        run, k = [], at[-1]
        while k is not None:
            run.append(once[k])
            k = came[k]
        run.reverse()
        yield from run
        for (i, j), (k, m) in zip([(p - 1, r - 1), *run], [*run, (q, s)], strict=True):
            yield from inside(i + 1, k, j + 1, m)

    return set(inside(0, len(a), 0, len(b)))


def test_versions_in_order(spark):
    rng = random.Random(2)
    pool = [f"{w} line about the {x} of the plant" for w in ("first", "second", "third", "last") for x in ("pump", "valve", "engine", "rig")] + ["", "}"]
    pairs = []
    for k in range(12):
        a = [rng.choice(pool) for _ in range(rng.randint(0, 25))]
        b = [line for line in a if rng.random() > 0.15]
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), rng.choice([*pool, "totally new words here", "first line about the pumps of the plants"]))
        pairs.append((k, a, b))
    pairs += [(50, [], ["only new"]), (51, ["only old"], []), (52, ["same"], ["same"])]
    side = lambda which: spark.createDataFrame([(k, i, line) for k, *ab in pairs for i, line in enumerate(ab[which])], "pair int, i int, line string")
    rows = V.align_versions(side(0), side(1), ["pair"]).collect()
    for k, a, b in pairs:
        own = [r for r in rows if r.pair == k]
        assert sorted(r.o for r in own if r.o is not None) == list(range(len(a))) and sorted(r.n for r in own if r.n is not None) == list(range(len(b)))
        anchors = {(r.o, r.n) for r in own if r.status == "unchanged"}
        assert anchors == plain_anchors(a, b)
        for r in own:
            assert (r.old, r.new) == (a[r.o] if r.o is not None else None, b[r.n] if r.n is not None else None)
            before = sum(x < r.o for x, _ in anchors) if r.o is not None else None
            if r.status == "modified":
                assert before == sum(y < r.n for _, y in anchors) and SequenceMatcher(None, r.old, r.new).ratio() >= 0.5 - 1e-6
            if r.status == "deleted":  # nothing like it was left in its gap
                assert not any(s.status == "added" and sum(y < s.n for _, y in anchors) == before and SequenceMatcher(None, r.old, s.new).ratio() >= 0.5 for s in own)
