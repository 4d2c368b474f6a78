"""A corpus pipeline of five stages; each is one operator of `inkwell.llm`, and its decisions take effect.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last; between stages the rows are
written and read again. Models are fitted on the labelled rows of the folder's own tables.

Defined results: documents rejected by language ID or toxicity go; of each near-duplicate component one row stays, the
one with the smallest doc_id (null ids last, then by the text's hash, of equal rows one); the mix repeats a document as
often as whole copies of it are taken, so the document on the edge of a source's budget is rounded (rows of one id,
source and size get the most that any of them gets); null and empty texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, langid, mixing, simhash, toxicity
from inkwell.llm.common import fresh_name, new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = langid.fit(labelled.where(~langid.held_out()))
    return langid.identify(docs, dictionaries, keep=True).where("not rejected").select("kept.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(labelled, labels, ~toxicity.held_out())
    return toxicity.score(docs, model, keep=True).where(F.col("score") < toxicity.THRESHOLD).select("kept.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs, mixing.words(), mixing.quality_weight(F.coalesce("text", F.lit(""))))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    plan = taken.groupBy(F.col("doc_id").alias("of"), F.col("source").alias("out_of"), F.col("size").alias("words")).agg(F.max(copies).alias("copies")).where("copies > 0")
    own = docs["doc_id"].eqNullSafe(plan["of"]) & docs["source"].eqNullSafe(plan["out_of"]) & (mixing.words().cast("long") == plan["words"])
    name = fresh_name("copy", docs.columns)
    return docs.join(plan, own).withColumn(name, F.explode(F.sequence(F.lit(1), plan["copies"]))).select(*[docs[c] for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", language), ("toxicity", toxic), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", mixed), ("byte-level BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
