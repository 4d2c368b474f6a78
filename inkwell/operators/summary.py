"""Extractive summaries: TextRank over the sentences of all documents at once, and how far paragraphs are covered by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import lower_words
from inkwell.operators.text import SENTENCE_ENDS, STOPWORDS, paragraphs

DAMPING, CLOSE, SENTENCES = 0.85, 1e-4, 5
#: A paragraph of at least SHORTEST characters and over FEW phrases adds little if under LOW of them are in the summary.
SHORTEST, FEW, LOW, PHRASE_WORDS = 50, 5, 0.15, 3
#: A phrase of these words only is none (fixed values).
PHRASE_STOPWORDS = ("a", "the", "and", "or", "but", "in", "is", "to", "of", "that", "this", "be", "as", "for", "on", "with", "by", "are", "was")


def document_sentences(text: Column) -> Column:
    """A document's sentences in order."""
    lines = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    cut = lambda p: F.transform(F.split(p, SENTENCE_ENDS["space"]), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(F.flatten(F.transform(lines, cut)), lambda s: s != "")


#: Numbers that an array of one turn holds at most, or those of one length of sentences.
CELLS = 4_000_000


def page_rank(sents: list[np.ndarray], damping: float, close: float) -> np.ndarray:
    """The ranks of a document's sentences, given as their content words; 0 for those without.

    The likeness of two sentences is their shared words over the sum of the logarithms of their lengths (over nothing if
    both have one word). As it depends on the lengths alone, what sentences of one length give to a word is added up
    first, and no pair of sentences is ever made.
    """
    lengths = np.array([len(x) for x in sents], dtype=np.int64)
    rank, live = np.zeros(len(sents)), np.flatnonzero(lengths)
    if not len(live):
        return rank
    n = lengths[live]
    _, word = np.unique(np.concatenate([sents[i] for i in live]).astype(str), return_inverse=True)
    kinds = word.max() + 1
    pair, c = np.unique(np.repeat(np.arange(len(n)), n) * kinds + word, return_counts=True)
    s, w = pair // kinds, pair % kinds
    first = np.searchsorted(s, np.arange(len(n)))
    different, kind = np.unique(n, return_inverse=True)
    block = max(1, CELLS // len(pair))

    def spread(given: np.ndarray) -> np.ndarray:
        got = np.zeros(len(n))
        for at in range(0, len(different), block):
            size = min(block, len(different) - at)
            here = (kind[s] >= at) & (kind[s] < at + size)
            to_words = np.bincount(w[here] * size + kind[s[here]] - at, (c * given[s])[here], kinds * size).reshape(kinds, size)
            shared = np.add.reduceat(c[:, None] * to_words[w], first)
            norm = np.log(n)[:, None] + np.log(different[at : at + size])
            got += (shared / np.where(norm > 0, norm, 1.0)).sum(axis=1)
        return got

    ties, now, moved = spread(np.ones(len(n))), np.full(len(n), 1 / len(n)), np.inf
    while moved > close:
        new = (1 - damping) / len(n) * now.sum() + damping * spread(now / ties)
        moved, now = np.sqrt(((new - now) ** 2).sum()), new
    rank[live] = now
    return rank


def text_rank(docs: DataFrame, damping: float = DAMPING, close: float = CLOSE) -> DataFrame:
    """(doc_id, sent, sentence, rank) of every sentence: PageRank on the graph of shared words of its document.

    A document's ranks are those after the first turn that moves them by at most `close` (Euclidean). They need its own
    row alone, so nothing is shuffled. Sentences without content words are not in the graph and have rank 0.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def ranks(sents: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else page_rank(list(x), damping, close) for x in sents])

    content = F.transform("s", lambda x: F.filter(lower_words(x), lambda w: ~w.isin(*STOPWORDS)))
    ranked = docs.select("doc_id", document_sentences(F.col("text")).alias("s")).select("doc_id", "s", ranks.asNondeterministic()(content).alias("r"))
    return ranked.select("doc_id", F.posexplode(F.arrays_zip("s", "r")).alias("sent", "x")).select("doc_id", "sent", F.col("x.s").alias("sentence"), F.col("x.r").alias("rank"))


def summaries(docs: DataFrame, most: int = SENTENCES) -> DataFrame:
    """(doc_id, sent, sentence, rank): the sentences of highest rank of each document; of equal ones (to 9 places) the first."""
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.round("rank", 9)), "sent")
    return text_rank(docs).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).drop("place")


def phrases(texts: DataFrame, text: Column, to: str, words: int = PHRASE_WORDS) -> DataFrame:
    """The rows without their text, and the distinct runs of so many lower-case words in it, but for those of stopwords only."""
    w = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.regexp_like(x, F.lit("^[a-z]+$")))
    # the words are a column of their own: an expression would be worked out anew for every run
    cut = texts.withColumn("w", w)
    run = lambda i: F.array(*[F.get("w", i + k) for k in range(words)])
    runs = F.when(F.size("w") >= words, F.transform(F.sequence(F.lit(0), F.size("w") - words), run)).otherwise(F.array())
    some = F.filter(runs, lambda r: F.exists(r, lambda x: ~x.isin(*PHRASE_STOPWORDS)))
    keys = [c for c in texts.columns if c not in ("text", "s")]
    return cut.select(*keys, F.array_distinct(F.transform(some, lambda r: F.array_join(r, " "))).alias(to))


def summary_coverage(docs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, phrases, coverage, low, reported) of every paragraph of enough characters.

    Coverage is the share of its phrases that the summary has; of the paragraphs that add little the first is reported.
    """
    chosen = summaries(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent", "sentence"))).alias("s"))  # a few sentences a document
    known = phrases(chosen, F.array_join(F.transform("s", lambda x: x["sentence"]), " "), "known")
    paras = phrases(paragraphs(docs).where(F.length(F.trim("text")) >= SHORTEST), F.col("text"), "own")
    coverage = F.size(F.array_intersect("own", F.coalesce("known", F.array()))) / (F.size("own") + 1)
    found = paras.join(known, "doc_id", "left").select("doc_id", "para_idx", F.size("own").alias("phrases"), coverage.alias("coverage"))
    low = (F.col("coverage") < LOW) & (F.col("phrases") > FEW)
    first = F.min(F.when(low, F.col("para_idx"))).over(Window.partitionBy("doc_id"))
    return found.select("doc_id", "para_idx", "phrases", F.round("coverage", 9).alias("coverage"), low.alias("low"), F.coalesce(low & (F.col("para_idx") == first), F.lit(False)).alias("reported"))
