"""Versions of a text compared in order: anchors, what lies in the gaps between them, and modified lines."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators.matching import characters, dice_part, one_to_one, seq_ratio, sharing
from inkwell.sources.stored import stored

#: Lines of one gap that are at least so alike are one line, modified.
MODIFIED = 0.5


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def longest_rising(values: pa.Array) -> pa.Array:
    """Places (from 1) of a longest strictly rising subsequence of each array; of several that of least last values."""
    out = []
    for row in values.to_pylist():
        ends: list[int] = []
        at: list[int] = []
        came = [-1] * len(row or [])
        for i, x in enumerate(row or []):
            k = bisect_left(ends, x)
            came[i] = at[k - 1] if k else -1
            ends[k:] = [x] if k == len(ends) else [x, *ends[k + 1 :]]
            at[k:] = [i] if k == len(at) else [i, *at[k + 1 :]]
        i, kept = at[-1] if at else -1, []
        while i >= 0:
            kept.append(i + 1)
            i = came[i]
        out.append(kept[::-1])
    return pa.array(out, pa.list_(pa.int32()))


def _in_order(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of pairs (keys, o, n) of line numbers those of a longest run that rises on both sides."""
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("of"))  # numbers of one pair of versions, no texts
    kept = rows.withColumn("kept", longest_rising(F.transform("of", lambda x: x["n"])))
    return kept.select(*keys, F.inline(F.transform("kept", lambda i: F.element_at("of", i))))


def _gaps(lines: DataFrame, anchors: DataFrame, keys: list[str], side: str) -> DataFrame:
    """The lines (keys, i, line) that are no anchors, with `gap`: how many anchors come before them."""
    marks = anchors.select(*keys, F.col(side).alias("i"), F.lit(1).alias("anchor"))
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = lines.join(marks, [*keys, "i"], "left").withColumn("gap", F.count("anchor").over(before))
    return found.where("anchor is null").drop("anchor")


def _unique(lines: DataFrame, keys: list[str], to: str) -> DataFrame:
    """(keys, gap, line, number): lines that a gap has once."""
    return lines.groupBy(*keys, "gap", "line").agg(F.count("*").alias("times"), F.min("i").alias(to)).where("times = 1").drop("times")


def anchored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, o, n): equal lines of both versions that are in order, both (keys, i, line).

    Lines that each side has once in a gap (at first the whole text) are candidates; a longest rising run of them is kept
    and makes smaller gaps, in which further lines are there once, until no gap has any. Then equal lines that begin or end
    a gap on both sides are paired from there on.
    """
    keyed = {"old": old, "new": new}
    anchors, more = None, True
    while more:
        if anchors is None:
            gaps = {k: v.withColumn("gap", F.lit(0).cast("long")) for k, v in keyed.items()}
        else:
            gaps = {k: _gaps(v, anchors, keys, side) for (k, v), side in zip(keyed.items(), ("o", "n"), strict=True)}
        pairs = _unique(gaps["old"], keys, "o").join(_unique(gaps["new"], keys, "n"), [*keys, "gap", "line"]).select(*keys, "gap", "o", "n")
        found = stored(_in_order(pairs, [*keys, "gap"]).select(*keys, "o", "n"))
        more = bool(found.limit(1).count())
        anchors = found if anchors is None else stored(anchors.unionByName(found))
    gaps = {k: stored(_gaps(v, anchors, keys, side)) for (k, v), side in zip(keyed.items(), ("o", "n"), strict=True)}
    for way in (F.asc, F.desc):
        place = F.row_number().over(Window.partitionBy(*keys, "gap").orderBy(way("i")))
        left, right = (gaps[k].withColumn("place", place).select(*keys, "gap", "place", F.col("line").alias(k), F.col("i").alias(to)) for k, to in (("old", "o"), ("new", "n")))
        run = Window.partitionBy(*keys, "gap").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        same = left.join(right, [*keys, "gap", "place"]).withColumn("broken", F.max((~F.col("old").eqNullSafe(F.col("new"))).cast("int")).over(run))
        edge = stored(same.where("broken = 0").select(*keys, "o", "n"))
        anchors = stored(anchors.unionByName(edge))
        gaps = {k: stored(gaps[k].join(edge.select(*keys, F.col(side).alias("i")), [*keys, "i"], "left_anti")) for k, side in (("old", "o"), ("new", "n"))}
    return anchors


def align_versions(old: DataFrame, new: DataFrame, keys: list[str], least: float = MODIFIED) -> DataFrame:
    """(keys, o, n, status, old, new) of every line of both versions, both (keys, i, line), numbers unique within keys.

    Status is unchanged for lines that are equal and in order; modified for two lines of one gap whose string ratio is at
    least `least`, the likest first, one to one; else deleted or added. The row of a missing side is null.
    """
    old, new = stored(old.select(*keys, "i", "line")), stored(new.select(*keys, "i", "line"))
    anchors = anchored(old, new, keys)
    gap = [*keys, "gap"]
    left, right = stored(_gaps(old, anchors, keys, "o")), stored(_gaps(new, anchors, keys, "n"))
    text = lambda df: df.select(*gap, F.col("line").alias("text"))
    met = sharing(text(left), text(right), gap, characters, dice_part(least)).withColumn("score", F.round(seq_ratio(F.col("a"), F.col("b")), 6)).where(F.col("score") >= least)
    ids = lambda df, to, name: df.select(*gap, F.col("i").alias(to), F.col("line").alias(name))
    changed = one_to_one(met.join(ids(left, "l", "a"), [*gap, "a"]).join(ids(right, "r", "b"), [*gap, "b"]), gap).select(*keys, F.col("l").alias("o"), F.col("r").alias("n"))
    paired = anchors.withColumn("status", F.lit("unchanged")).unionByName(changed.withColumn("status", F.lit("modified")))
    was = old.select(*keys, F.col("i").alias("o"), F.col("line").alias("old"))
    now = new.select(*keys, F.col("i").alias("n"), F.col("line").alias("new"))
    both = was.join(paired, [*keys, "o"], "left").join(now, [*keys, "n"], "full")
    status = F.coalesce("status", F.when(F.col("o").isNull(), "added").otherwise("deleted"))
    return both.select(*keys, "o", "n", status.alias("status"), "old", "new")


def version_statistics(aligned: DataFrame, keys: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "modified", "added", "deleted")]
    return aligned.groupBy(*keys).agg(*counts)


def version_lines(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, i, line): the lines of a text, numbered, without white space at their ends; a null text has none."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("i", "line")).withColumn("line", F.rtrim("line"))
