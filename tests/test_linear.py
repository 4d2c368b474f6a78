import re

from pyspark.sql import functions as F

from inkwell.functions.linear import holding
from inkwell.operators import packs as P


def test_ranks_are_those_of_a_scan_by_each_pattern(spark):
    patterns, blanked = [r"\bshort\b", r"\bin\s+order\b", r"b+$", r"\w+_"], ["", "", "", r"\bshort\b"]
    texts = ["a short text", "short in\norder", "in order bb", "", None, "bb b_c", "x short y", "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.held for r in rows.select("i", holding(patterns, blanked)(F.col("t")).alias("held")).collect()}
    want = lambda t: [k for k, (p, b) in enumerate(zip(patterns, blanked, strict=True)) if re.search(p, re.sub(b, "_", t) if b else t)]
    assert got == {i: want(t or "") for i, t in enumerate(texts)}


def test_packs_find_what_each_pack_alone_finds(spark):
    texts = [f"{p} {q}" for pack in P.PACKS for p in list(pack.phrases)[:3] + list(pack.without)[:1] for q in ("shall be in\vfront of it.", "may_be it's  a make  a decision")]
    paras = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, para_idx int, text string")
    scanned = P.pack_scan(paras)
    got = sorted((r.doc_id, r.pack, r.hit_idx, r.hit) for r in scanned.collect())
    flat = paras.select("doc_id", P.flat(F.col("text")).alias("t"))
    want = sorted((r.doc_id, p.name, r.i, r.h) for p in P.PACKS for r in flat.select("doc_id", F.posexplode(P.hits(F.col("t"), p)).alias("i", "h")).collect())
    assert got == want
    assert "ArrowEvalPython" in scanned._jdf.queryExecution().executedPlan().toString()  # else every pack scans every paragraph
