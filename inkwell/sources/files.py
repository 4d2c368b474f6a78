"""Corpora, file listings and term lists as tables, and results as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "doc_id long, text string, lang string, source string"


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", columns: dict[str, str] | None = None, **options: str) -> DataFrame:
    """documents (doc_id, text, lang, source) from parquet, json or csv tables, or from whole text files.

    columns: the table's name of each of ours. Missing ones are null; without an id it is the hash of path and text, so
    that it does not depend on how rows are dealt.
    """
    if fmt == "text":
        raw = spark.read.options(**options).text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    else:
        raw = spark.read.format(fmt).options(**options).load(path)
    own, out = columns or {}, []
    for name, kind in (x.split(" ") for x in CORPUS.split(", ")):
        given = own.get(name, name)
        c: Column = F.col(given) if given in raw.columns else F.lit(None)
        if name == "doc_id" and given not in raw.columns:
            c = F.xxhash64(F.col("source") if "source" in raw.columns else F.lit(""), F.col(own.get("text", "text")))
        out.append(c.cast(kind).alias(name))
    return raw.select(*out)


def discover_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, extension, size, modified) of all files below a folder; contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    named = found.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    return (named.where(F.col("extension").isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else named).select("path", "extension", "size", "modified")


def load_dictionary(spark: SparkSession, paths: list[str], *more: DataFrame) -> DataFrame:
    """(word): the distinct terms of files with one term a line, in lower case without comments, and of the given tables (word)."""
    line = F.trim(F.lower("value"))
    files = spark.read.text(paths).where((line != "") & ~F.startswith(line, F.lit("#"))).select(line.alias("word"))
    return reduce(DataFrame.unionByName, [m.select(F.lower("word").alias("word")) for m in more], files).distinct()


def chosen_issues(issues: DataFrame, severities: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> DataFrame:
    """Issues of these severities and categories, all of them where none is given."""
    for column, values in (("severity", severities), ("category", categories)):
        if values:
            issues = issues.where(F.col(column).isin(*values))
    return issues


def write_issues(issues: DataFrame, path: str, fmt: str = "json", severities: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> None:
    """The chosen issues as csv, json or parquet files, one folder a severity; an existing folder is an error."""
    writer = chosen_issues(issues, severities, categories).write.format(fmt).partitionBy("severity")
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def shown_links(results: DataFrame) -> DataFrame:
    """Link results (url, status, excluded, treat_as_valid) with the status that is shown: excluded ones that count as valid work."""
    shown = F.when(F.col("excluded") & F.coalesce("treat_as_valid", F.lit(False)), "WORKING").otherwise(F.col("status"))
    return results.withColumn("status", shown)


def write_link_results(results: DataFrame, path: str, fmt: str = "json") -> None:
    writer = shown_links(results).write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
