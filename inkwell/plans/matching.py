"""Queries on fuzzy matching, differences and diversity; those whose string ratio SQL cannot state have literal tests instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators import matching as M
from inkwell.plans.metrics import COUNTED, TOKENS, docs
from inkwell.registry import query, table


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, old, new): turns of a conversation with the next one."""
    later = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("old"), later.alias("new")).where("new is not null")


@query("f3_seq_ratio")
def seq_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("conv_id", "turn", F.round(M.seq_ratio("old", "new"), 9).alias("ratio"))


@query("w14_word_diff")
def word_diff(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("conv_id", "turn", F.posexplode(M.word_changes("old", "new")).alias("place", "c")).select("conv_id", "turn", "place", "c.op", "c.old", "c.new")


@query("j14_similar_pairs")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    names = part.select(F.concat_ws(" ", "p_brand", "p_type").alias("text")).distinct().select(F.md5("text").alias("id"), "text")
    return M.similar_names(names, core=("large", "small"))


@query("j15_align_items")
def align_items(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_type").alias("category"))
    return M.aligned_items(part.where("id % 2 = 0"), part.where("id % 2 = 1"), ["p_brand"])


@query("j18_detect_moves")
def detect_moves(spark: SparkSession, sf: str) -> DataFrame:
    cut = lambda c: F.posexplode(F.split(c, r"(?<=[.!?])\s+")).alias("place", "text")
    side = lambda c: turns(spark, sf).select("conv_id", "turn", cut(c)).select("conv_id", (F.col("turn") * 1000 + F.col("place")).alias("id"), "text")
    return M.moves(side("old"), side("new"), ["conv_id"])


@query("a73_diff_statistics", "WITH r AS (SELECT l_suppkey AS pair, ['unchanged', 'added', 'deleted', 'modified', 'moved'][l_partkey % 5 + 1] AS status, l_orderkey % 20 AS section FROM lineitem) SELECT pair, " + ", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ("unchanged", "added", "deleted", "modified", "moved")) + ", count(DISTINCT section) FILTER (status <> 'unchanged') AS sections, round(count(*) FILTER (status <> 'unchanged') * 100.0::DOUBLE / count(*), 6) AS change_index FROM r GROUP BY pair")
def diff_statistics(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("unchanged", "added", "deleted", "modified", "moved"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return M.diff_summary(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pair"), status.alias("status"), (F.col("l_orderkey") % 20).alias("section")), ["pair"])


@query("a11_hdd", f"WITH {TOKENS}, {COUNTED}, k AS (SELECT doc_id, n AS k, count(*) AS types FROM counted GROUP BY ALL), t AS (SELECT doc_id, sum(k * types)::BIGINT AS n FROM k GROUP BY 1), p AS (SELECT doc_id, t.n, types * (1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(42), lambda i: greatest(0.0::DOUBLE, (t.n - k - i) / (t.n - i)::DOUBLE))), lambda x, y: x * y)) / 42 AS s FROM k JOIN t USING (doc_id) WHERE t.n >= 42) SELECT t.doc_id, round(sum(s), 9) AS hdd FROM t LEFT JOIN p USING (doc_id) GROUP BY t.doc_id")
def hdd(spark: SparkSession, sf: str) -> DataFrame:
    return M.hdd(docs(spark, sf))


@query("a11_mtld")
def mtld(spark: SparkSession, sf: str) -> DataFrame:
    return M.mtld(docs(spark, sf))
