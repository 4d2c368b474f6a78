"""Toxicity by a counterfactual-regularised classifier.

A linear model over the distinct words of a text, fitted on labelled documents by proximal gradient steps (logistic
loss; an L1 term picks the words with evidence, which are then fitted again without it). Each labelled sentence that names an identity group
is copied with the term swapped for others of its list, and the squared change of the score is penalised: mentioning one
group or another may not change the judgement, so neutral mentions are not mistaken for insults. The terms' own weights
are drawn to zero by the same penalty against the sentence without the term.

The model is fitted on a bounded sample (`sample_rows` labelled rows a class, by the hash of the id), on words that at
least `RARE` of its documents have, and on identity terms and their swaps however rare; whole texts of all rows are
scored, word by word, in one pass without a shuffle.

Where no labelled sentence names a group, as in the test tables, the penalty has no pairs and the model is the plain one.

Defined results: a label that is repeated with other values counts as the greatest; of rows that share an id the least
text is learned from; scores at the threshold count as toxic; very long texts are scored whole, a word once; other
columns of any name are ignored, and with `keep` returned in the struct `kept`; null and empty texts get the score of a text without known words; rows without a label, or with a null
one, are only scored; with no labels, or one class only, the score is that class's share (0 without any); repeated
rows each get a row.
"""

from __future__ import annotations

import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import judged, kept, remainder, spread_sample

SAMPLE_ROWS = 2_500
BUCKETS = 1 << 20
L1, L2, COUNTERFACTUAL, ROUNDS = 3e-3, 1e-4, 1.0, 120
RARE = 3
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Terms that name groups of people, list by list; a term is swapped for others of its list.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("women", "men", "girls", "boys", "immigrants", "refugees"),
    ("woman", "man", "girl", "boy", "immigrant", "refugee"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
)
SWAPS = {t: tuple(o for o in group if o != t) for group in IDENTITY for t in group}


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(text: str) -> np.ndarray:
    return np.unique(np.array([bucket(w) for w in set(words_of(text))], np.int64))


def counterfactuals(text: str, rng: random.Random) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features only in the sentence, features only in its copy) for every identity term, swapped and dropped."""
    out = []
    for sentence in SENTENCE.split(text):
        words = set(words_of(sentence))
        terms = sorted(w for w in words if w in SWAPS)
        times = Counter(map(bucket, words)) if terms else {}
        for term in terms:
            for other in (rng.choice(SWAPS[term]), None):
                gone, new = bucket(term), None if other is None else bucket(other)
                before = [gone] if times[gone] == 1 and gone != new else []
                out.append((np.array(before, np.int64), np.array([] if new is None or new in times else [new], np.int64)))
    return out


class Rows:
    """A sparse matrix of ones with signs, as numpy arrays."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray] | None = None):
        self.n = len(rows)
        self.at = np.concatenate([*rows, np.empty(0, np.int64)])
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.sign = np.concatenate([*signs, np.empty(0)]) if signs is not None else np.ones(len(self.at))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.at] * self.sign, self.n)

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, values[self.row] * self.sign, size)

    def only(self, columns: np.ndarray, size: int) -> Rows:
        """The same rows with these columns alone, numbered anew."""
        new = np.full(size, -1)
        new[columns] = np.arange(len(columns))
        out, keep = Rows([]), new[self.at] >= 0
        out.n, out.at, out.row, out.sign = self.n, new[self.at[keep]], self.row[keep], self.sign[keep]
        return out


def descend(x: Rows, y: np.ndarray, mass: np.ndarray, swap: Rows, size: int, l1: float, l2: float, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps; the step is the inverse of the curvature's bound, found by power iteration."""
    share = 2 * penalty / max(1, swap.n)
    v, v0, bound = np.ones(size), 1.0, 1.0
    for _ in range(12):
        z = mass * (x.times(v) + v0) / 4
        u, u0 = x.back(z, size) + share * swap.back(swap.times(v), size), z.sum()
        bound = float(np.sqrt(u @ u + u0 * u0)) or 1.0
        v, v0 = u / bound, u0 / bound
    step = 0.9 / (bound + l2)
    weights, bias, ahead, ahead_bias, t = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
    for _ in range(rounds):
        pull = mass * (1 / (1 + np.exp(-np.clip(x.times(ahead) + ahead_bias, -50, 50))) - y)
        w = ahead - step * (x.back(pull, size) + share * swap.back(swap.times(ahead), size) + l2 * ahead)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = ahead_bias - step * float(pull.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = w + (t - 1) / t2 * (w - weights), b + (t - 1) / t2 * (b - bias)
        weights, bias, t = w, b, t2
    return weights, bias


def train(texts: list[str], labels: list[int], l1: float = L1, penalty: float = COUNTERFACTUAL, rounds: int = ROUNDS) -> tuple[dict[int, float], float]:
    """({bucket: weight}, bias) by accelerated proximal gradient steps; both classes weigh the same."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {}, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = random.Random(0)
    sets = [features(t) for t in texts]
    pairs = [p for t in texts for p in counterfactuals(t, rng)]
    seen, times = np.unique(np.concatenate(sets), return_counts=True)
    used = np.unique(np.concatenate([seen[times >= RARE], *[x for p in pairs for x in p]]))
    place = lambda f: np.searchsorted(used, f[np.isin(f, used, assume_unique=True)])
    placed = [place(s) for s in sets]
    # columns are scaled by their words' log odds: words as common in both classes hardly move, and few rounds are enough
    in_one = np.bincount(np.concatenate([p for p, k in zip(placed, y, strict=True) if k]), minlength=len(used))
    in_all = np.bincount(np.concatenate(placed), minlength=len(used))
    odds = np.log((in_one + 0.5) / (y.sum() + 1)) - np.log((in_all - in_one + 0.5) / ((1 - y).sum() + 1))
    x = Rows(placed, [odds[p] for p in placed])
    swap = Rows([np.searchsorted(used, np.r_[a, b]) for a, b in pairs], [np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs])
    swap.sign *= odds[swap.at]
    mass = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    weights, _ = descend(x, y, mass, swap, len(used), l1, 0.0, penalty, rounds)
    kept = np.flatnonzero(weights)  # the words with evidence; their weights are fitted again without the L1 term's shrinking
    weights, bias = descend(x.only(kept, len(used)), y, mass, swap.only(kept, len(used)), len(kept), 0.0, L2, penalty, rounds)
    return {int(u): float(v) for u, v in zip(used[kept], weights * odds[kept], strict=True)}, bias


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, training: Column, sample_rows: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most `sample_rows` labelled training rows a class, in the order of their ids' hash."""
    known = labels.where(training & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    chosen = spread_sample(known, "label", id_col, "labels", sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).groupBy("chosen", "of_group").agg(F.min("text")).collect()
    return [(text, label) for _, label, text in sorted(rows, key=lambda r: (str(r[0]), r[1]))]


def fit(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, **more: float) -> tuple[dict[int, float], float]:
    sample = labelled_sample(docs, labels, label_col, training, sample_rows)
    return train([t for t, _ in sample], [y for _, y in sample], **more)


def score_text(text: str | None, weights: dict[int, float], bias: float, known: dict[str, float]) -> float:
    """known: a cache of words' weights, filled on the way."""
    found = set(words_of(text or ""))
    if new := found.difference(known):
        if len(known) > 300_000:
            known.clear()
            new = found
        known.update((w, weights.get(bucket(w), 0.0)) for w in new)
    z = bias + sum(map(known.__getitem__, sorted(found)))
    return float(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))))


def score(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, score) of every row, and with `keep` its columns in a struct `kept`."""
    shared, number = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def judge(texts: list) -> list[tuple]:
        known = kept("toxicity", number, dict)
        return [(score_text(t, *shared.value, known),) for t in texts]

    return judged(docs, judge, [("score", T.DoubleType())], id_col, text_col, keep)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 3) == 1


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
