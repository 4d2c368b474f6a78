"""From documents to lines, sentences, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import lower_words

#: Lines that are boilerplate wherever they stand (fixed values, matched without regard to case).
BOILERPLATE = (
    r"^\s*Copyright\s*[©®]?\s*\d{4}",
    r"^\s*All rights reserved",
    r"^\s*No part of this publication",
    r"^\s*Page\s*\d+\s*(of|/)\s*\d+",
    r"^\s*EFFECTIVE\s*DATE\s*[:=]",
    r"^\s*REVIEW\s*DATE\s*[:=]",
    r"^\s*Issued\s+\d{4}",
    r"^\s*Revised\s+\d{4}",
    r"^\s*Superseding\s+",
    r"^\s*Licensee\s*=",
    r"^\s*No reproduction",
    r"^\s*Not for Resale",
    r"^\s*TO PLACE.*ORDER",
    r"^\s*Tel:\s*[\d\-\(\)\+]+",
    r"^\s*Fax:\s*[\d\-\(\)\+]+",
    r"^\s*Email:\s*\S+@\S+",
    r"^\s*Document Owner",
    r"^\s*Applies To:",
    r"^\s*Prepared by.*Committee",
    r"www\.\w+\.(com|org|gov)",
    r"https?://\S+",
    r"^\s*SAE\s+(INTERNATIONAL|International)",
    r"provided by IHS",
    r"without license from",
    r"^\s*--[`,\-]+--",
    r"^\s*NOTE\s*\d+\s*:",
    r"^\s*RATIONALE\s*$",
    r"^\s*TABLE OF CONTENTS",
    r"^\.\.\.\.\d+$",
)
BOILERPLATE_PATTERN = "(?i)" + "|".join(BOILERPLATE)
#: The same in two parts, of which one is tried at the beginning only, and the other where its first letters are.
AT_THE_START = "(?i)^(?:" + "|".join(p[1:] for p in BOILERPLATE if p.startswith("^")) + ")"
ANYWHERE = "(?i)(?=[whp])(?:" + "|".join(p for p in BOILERPLATE if not p.startswith("^")) + ")"
#: Where a text is cut into sentences, by mode; white space is looked for first.
SENTENCE_ENDS = {"space": r"\s(?<=[.!?]\s)\s*", "capital": r"\s(?<=[.!?]\s)\s*(?=[A-Z])", "marks": r"[.!?]+"}
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "not", "of", "on", "or", "our", "she", "so", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were", "which", "who", "will", "with", "you", "your")


def paragraphs(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, para_idx, text): the non-blank parts of each text, numbered from 0 over all parts."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("para_idx", "text"))
    return parts.where(F.trim("text") != "")


def is_boilerplate(text: Column) -> Column:
    return (F.length(F.trim(text)) < 5) | F.regexp_like(text, F.lit(AT_THE_START)) | F.regexp_like(text, F.lit(ANYWHERE))


def drop_boilerplate(paras: DataFrame) -> DataFrame:
    return paras.where(~is_boilerplate(F.col("text")))


def sentences(paras: DataFrame, mode: str = "space") -> DataFrame:
    """(the paragraph's keys, sent_idx, sentence): trimmed, without blanks."""
    keys = [c for c in paras.columns if c != "text"]
    return paras.select(*keys, F.posexplode(cut_sentences(F.col("text"), mode)).alias("sent_idx", "sentence")).where("sentence <> ''")


def cut_sentences(text: Column, mode: str = "space") -> Column:
    """The trimmed sentences of a text, blank ones too. They are trimmed in the array: a filter on rows would trim them again."""
    return F.transform(F.split(text, SENTENCE_ENDS[mode]), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word) in lower case."""
    return docs.select("doc_id", F.posexplode(lower_words(F.col("text"))).alias("pos", "word"))


def without_stopwords(words: DataFrame, stopwords: tuple[str, ...] = STOPWORDS, shortest: int = 3) -> DataFrame:
    return words.where((F.length("word") >= shortest) & ~F.col("word").isin(*stopwords))


def ngrams(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, pos, gram): n words in a row, space-joined. Texts of fewer words have none."""
    w = docs.select("doc_id", lower_words(F.col("text")).alias("w")).where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return w.select("doc_id", F.posexplode(grams).alias("pos", "gram"))


def heading(line: Column) -> tuple[Column, Column]:
    """(number, title) of a line that is a heading: numbered, marked with #, or in capitals; else nulls."""
    numbered = r"^\s*(\d+(?:\.\d+)*)\.?\s+([A-Z].*)$"
    marked = r"^#{1,6}\s+(.+)$"
    capitals = F.regexp_like(line, F.lit(r"^[A-Z][A-Z0-9 ,&/-]{4,}$"))
    number = F.when(F.regexp_like(line, F.lit(numbered)), F.regexp_extract(line, numbered, 1))
    title = F.when(number.isNotNull(), F.trim(F.regexp_extract(line, numbered, 2))).when(F.regexp_like(line, F.lit(marked)), F.trim(F.regexp_extract(line, marked, 1))).when(capitals, F.trim(line))
    return number, title


def with_sections(lines: DataFrame) -> DataFrame:
    """Every line with the latest heading at or before it in its document ('' before the first)."""
    number, title = heading(F.col("text"))
    named = F.when(title.isNotNull(), F.concat_ws(" ", number, title))
    before = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", named).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(before), F.lit("")))


ALLOWED_REPEATS = ("that", "had", "very", "really")


def repeats(text: Column) -> Column:
    """Every word twice in a row with only white space between."""
    return F.regexp_extract_all(text, F.lit(r"(?iU)\b(\w++)\s++\1\b"), F.lit(0))


def is_repeat(hit: Column, allowed: tuple[str, ...] = ALLOWED_REPEATS) -> Column:
    return ~F.lower(F.regexp_extract(hit, r"(?U)^(\w+)", 1)).isin(*allowed)


def repeated_words(paras: DataFrame, allowed: tuple[str, ...] = ALLOWED_REPEATS) -> DataFrame:
    """(the paragraph's keys, hit): a word twice in a row with only white space between, but for the allowed ones."""
    keys = [c for c in paras.columns if c != "text"]
    return paras.select(*keys, F.posexplode(repeats(F.col("text"))).alias("hit_idx", "hit")).where(is_repeat(F.col("hit"), allowed))
