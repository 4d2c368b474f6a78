"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Sources share a budget by weight. A source's target first takes complete epochs of all its documents; the fraction of
an epoch that is left goes to the documents of least key, where a document's key is an exponential variate (made from
the hash of its id and a seed) divided by its quality weight, so that better documents come first more often. Keys are
summed up within the source until the fraction is full; the document on the edge gives only the words still missing.

A source may hold most rows, so the sums are found in two steps: sizes are added up by (source, key bucket), running
sums over a source's buckets give each bucket its start, and only inside a bucket documents are ordered and summed.
Buckets cut the keys at quantiles of the law that the source's weights give them (a mixture of exponential laws, from a
count of weights by tenths), so they come out about equal. A source of n documents has the square root of n buckets
unless `buckets` says otherwise, so neither the documents of a bucket nor the buckets of a source become many.

Defined results: null texts have size 0; a null source is a source of its own, last in order; a source without words
has target 0; repeated rows count each on its own, equal keys are ordered by id; with no rows there is no mix; a null
id is hashed like the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WORDS, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix"


def quality_weight(text: Column) -> Column:
    """From 0.1 (no letters) to 1 (letters and spaces only), by how many characters are neither, each counted thrice."""
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\s.,]"))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(3.0) * odd / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The rows (source, source_size, ...) with their target: budget by weight under a cap, the excess shared anew.

    Sources in the order of cap over weight fill up first: one is at its cap if the level that the rest of the budget
    allows to it and its successors reaches it. One row a source.
    """
    by_code_point = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_epochs)
    budget = F.sum("source_size").over(every) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_level * F.col("weight"))
    return leveled.select(*sizes.columns, target.alias("target"))


def mix(docs: DataFrame, size: Column, weight: Column, id_col: str = "doc_id", source_col: str = "source", buckets: int | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row; taken counts words, repeats included."""
    # the hash gives 48 bits, so the uniform variate is exact in a double and never 0 or 1
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("long")
    uniform = (bits.cast("double") + 0.5) / F.lit(float(1 << 48))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"), F.coalesce(weight, F.lit(0.1)).alias("weight"), (-F.log(uniform)).alias("key"))
    sized = written(sized.withColumn("key", F.col("key") / F.col("weight")), "mix-sizes")
    tenth = F.greatest(F.lit(1), F.least(F.lit(10), F.round(F.col("weight") * 10)))
    tenths = F.array(*[F.count_if(tenth == i) for i in range(1, 11)])
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), tenths.alias("tenths")))
    below = sum(F.col("tenths")[i] * (1 - F.exp(-F.col("key") * (i + 1) / 10)) for i in range(10)) / F.col("n")
    aimed = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).drop(aims["source"]).withColumn("bucket", F.floor((F.ceil(F.sqrt("n")) if buckets is None else F.lit(buckets)) * below))
    per = aimed.groupBy("source", "bucket").agg(F.sum("size").alias("inside"))
    start = per.withColumn("start", F.coalesce(F.sum("inside").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("of"), F.col("bucket").alias("number"), "start")
    placed = aimed.join(start, aimed["source"].eqNullSafe(start["of"]) & (aimed["bucket"] == start["number"]))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    goal = F.floor(F.col("target") + 0.5)
    epochs = F.floor(goal / F.greatest("source_size", F.lit(1)))
    left = goal - epochs * F.col("source_size") - before
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, words(), quality_weight(F.coalesce("text", F.lit("")))).drop("source")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((('0x' || substr(md5('mix/' || doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
      / greatest(0.1, 1.0 - 3.0 * len(regexp_extract_all(coalesce(text, ''), '[^\p{L}\s.,]')) / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM sums
), leveled AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE
    ELSE (SELECT arg_min(level, (cap / weight, source IS NULL, source)) FROM leveled WHERE cap > level * weight) * weight END AS target
  FROM leveled
), placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, floor(a.target + 0.5)::BIGINT AS goal,
    floor(floor(a.target + 0.5) / greatest(a.source_size, 1))::BIGINT AS epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, goal - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""
