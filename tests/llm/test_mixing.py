import pyspark.sql.functions as F

from inkwell.llm import mixing as M


def water(sizes):
    """Targets by repeated sharing, as the rule says."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w >= 2 * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / w for s in open_})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= set(over)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    return target


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def mixed(df, **more):
    return M.mix(df, M.words(), M.quality_weight(F.coalesce("text", F.lit(""))), **more)


def test_targets_and_taken(spark):
    rows = [(i, ["a", "b", "c", "d", "e", None][i % 6 if i % 4 else 0], "w " * (i * 7 % 50) if i % 9 else None) for i in range(400)]
    rows += [(7, "a", "x y"), (7, "a", "x y"), (None, "z", "one two"), (500, "empty", ""), (501, "empty", None)]
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    first = mixed(frame(spark, rows)).collect()
    assert len(first) == len(rows)
    for s in sizes:
        own = [r for r in first if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
        epochs = int(own[0].target // max(1, sizes[s]))
        assert all(min(epochs, 2) * r.size <= r.taken <= 2 * r.size for r in own)
    for more in ({"buckets": 1}, {"buckets": 90}, {}):  # buckets and partitions change nothing
        assert sorted(mixed(frame(spark, rows).repartition(7), **more).collect(), key=str) == sorted(first, key=str)


def test_better_documents_come_first(spark):
    rows = [(i, "a", "good words here") for i in range(500)] + [(1000 + i, "a", "#### %%%% @@@@") for i in range(500)]
    rows += [(5000 + i, "b", "w") for i in range(10)]
    got = mixed(frame(spark, rows)).where("source = 'a'").collect()
    good = sum(r.taken for r in got if r.doc_id < 1000)
    assert good > 1.1 * sum(r.taken for r in got if r.doc_id >= 1000)


def test_no_rows(spark):
    assert mixed(frame(spark, [])).count() == 0


def test_clashing_columns_and_a_long_text(spark):
    rows = [(i, f"word {i} " * (i % 9), f"s{i % 2}") for i in range(60)] + [(100, "word " * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = df.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate("size weight key n tenths target bucket inside start of number taken source_size".split())])
    mix = lambda d: sorted(map(tuple, M.mix(d, M.words(), M.quality_weight(F.coalesce("text", F.lit("")))).collect()), key=str)
    assert mix(wide) == mix(df) and max(r[2] for r in mix(df)) == 100_000
