"""A quality classifier with supervised subword embeddings.

Each word of a text (a run of non-space characters) stands for hashed features: itself, its shape (kinds of characters
in a row), its character n-grams with word ends, and the word pair with its predecessor where both are the same word. A
document is the average of its features' learned vectors; a softmax over the two classes reads it. Vectors and output
are trained together by stochastic gradient descent in numpy, with steps that adapt to each vector's past gradients.

Trained on a bounded sample (`sample_rows` labelled rows a class, by the hash of the id). As the output is linear in
the average, a word's contribution is a number, found once for each distinct word a task meets; scoring whole texts is
then one pass over their words, without a shuffle.

Defined results: a label that is repeated with other values counts as the greatest; scores at the threshold count as
good; very long texts are read whole; other columns of any name are ignored; null and empty texts, and texts of spaces, get the output's bias alone; with no labels, or one class
only, the score is that class's share (0.5 without any); repeated rows each get a row.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import judged, kept, remainder
from inkwell.llm.toxicity import labelled_sample

SAMPLE_ROWS = 1_500
BUCKETS, DIMS = 1 << 16, 8
SHORTEST, LONGEST = 3, 4
EPOCHS, RATE = 8, 0.5
THRESHOLD = 0.7


def shape(word: str) -> str:
    """Runs of upper-case letters, lower-case letters, digits and each other character, by one sign each."""
    if word.islower() and word.isalpha():
        return "a"
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return "".join([k for k, before in zip(kinds, ["", *kinds], strict=False) if k != before])


def subwords(word: str) -> list[int]:
    """The buckets of the word, its shape, and its n-grams of characters, ends marked."""
    marked = f"\x02{word}\x03"
    grams = [word, "\x01" + shape(word), *(marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


#: The feature of a word pair of one word twice, whichever word it is; it weighs as much as a word's other features.
SAME = zlib.crc32(b"\x01\x01") % BUCKETS
SAME_TIMES = 8


def repeats(words: list[str]) -> int:
    """Words that equal their predecessor."""
    return sum(map(str.__eq__, words, words[1:]))


class Model:
    """The worth of each bucket towards class 1 (its vector times the output), and the bias."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: float):
        self.worth = (vectors @ output).tolist()
        self.bias = bias

    def score(self, text: str | None, known: dict[str, float]) -> float:
        """known: a cache of words' worths, filled on the way."""
        words, worth = (text or "").split(), self.worth
        if new := set(words).difference(known):
            if len(known) > 300_000:
                known.clear()
                new = set(words)
            known.update((w, sum([worth[b] for b in subwords(w)])) for w in new)
        same = SAME_TIMES * repeats(words)
        total = sum(map(known.__getitem__, words)) + same * worth[SAME]
        n = sum(map(len, words)) * 2 + len(words) + same  # a word of c characters has 2c + 1 features
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    y = np.array(labels, float)
    rng = np.random.default_rng(seed)
    vectors, output, bias = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)), rng.uniform(-1, 1, DIMS), 0.0
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros((BUCKETS, DIMS)), output, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    docs, cache = [], {}
    for t in texts:
        words = t.split()
        same = repeats(words)
        sums = Counter({SAME: same * SAME_TIMES}) if same else Counter()
        for w, c in Counter(words).items():
            if w not in cache:
                cache[w] = subwords(w)
            for b in cache[w]:
                sums[b] += c
        share = np.fromiter(sums.values(), np.float32, len(sums))
        docs.append((np.fromiter(sums, np.int32, len(sums)), share / max(1.0, float(share.sum()))))
    cache.clear()
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    past, past_output, steps, step = np.full(BUCKETS, 1e-8), np.full(DIMS, 1e-8), epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, share = docs[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[at]
            p = 1 / (1 + np.exp(-np.clip(mean @ output + bias, -30, 30)))
            pull = weigh[i] * (p - y[i])
            past[at] += (pull * share) ** 2 * float(output @ output)
            past_output += (pull * mean) ** 2
            vectors[at] -= lr * pull * (share / np.sqrt(past[at]))[:, None] * output
            output = output - 0.1 * lr * pull * mean / np.sqrt(past_output)
            bias -= 0.02 * lr * pull
    return Model(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(docs, labels, label_col, training, sample_rows)
    return train([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, score) of every row, and with `keep` its columns in a struct `kept`."""
    shared, number = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def judge(texts: list) -> list[tuple]:
        known = kept("quality", number, dict)
        return [(shared.value.score(t, known),) for t in texts]

    return judged(docs, judge, [("score", T.DoubleType())], id_col, text_col, keep)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 4) == 2


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
