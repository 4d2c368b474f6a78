"""Filter interaction audit: what each filter of a chain removes, in every order, from one pass over the texts.

Each document gets a mask of the filters it fails, and from it a 32-bit survival word, a truth table over the subsets of
the five filters: bit S is 1 if the document survives all filters of subset S. Positional popcounts of the words, per part
and label, give the survivors of every subset, and the counts of any order and step are differences of these. The
popcounts are carry-save: three columns of bits become a column of sums and one of carries at twice the weight, for all
32 positions at once, until at most two words of a weight are left to be counted bit by bit.

Filters (failure conditions): A under 100 words; B under 80 % distinct words; C over 10 % capitals A-Z of the code points;
D a mark of `#$%&*|`; E the same text as a row of a smaller doc_id. Words are runs of anything but ASCII white space.

Texts are read once, where they lie; only ids, masks and digests are shuffled. Equal texts meet by SHA-256 under partial
aggregation, and digests with very many rows are joined by broadcast (`graph.with_hubs`). At most 32 rows a part and label
class of a batch go into the last sums.

Defined results: a null text is empty, so it fails A and possibly E; a null lang is the part of the empty text; a null
doc_id is no smaller id, has none, and no label; repeated rows count each on its own, and rows of one id and one text do
not make each other fail E; a document with several label rows is good (toxic) if one of them says so; labels without a
document count nowhere; with no rows there are no parts; a very long text is split whole in its task; other columns of any
name are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import by_small_batches, kept, slices, written
from inkwell.operators.graph import with_hubs

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
_BYTES = bytes(range(256))
_NOT_CAPITAL = bytes(b for b in _BYTES if not 65 <= b <= 90)
_CONTINUING = bytes(range(0x80, 0xC0))
_NOT_MARK = bytes(b for b in _BYTES if b not in MARKS)


def survival_word(mask: int) -> int:
    """Bit S is 1 if none of the filters in S is failed."""
    return sum(1 << s for s in range(ALL + 1) if not s & mask)


WORDS_OF_MASKS = [survival_word(m) for m in range(ALL + 1)]


def failed(text: bytes) -> int:
    """The mask of the filters A to D that a text fails."""
    words = text.split()  # of bytes: ASCII white space only
    points = len(text.translate(None, _CONTINUING))
    mask = BIT["A"] * (len(words) < LEAST_WORDS)
    mask |= BIT["B"] * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
    mask |= BIT["C"] * (100 * len(text.translate(None, _NOT_CAPITAL)) > MOST_CAPITALS * points)
    return mask | BIT["D"] * bool(text.translate(None, _NOT_MARK))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, digest of the text, mask of A to D) of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("audit")
        for batch in batches:
            for piece in slices(batch, "text", 4_000_000):
                texts = [x.as_buffer().to_pybytes() for x in piece.column("text")]
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), digests, pa.array(map(failed, texts), pa.int32())], ["doc_id", "part", "digest", "mask"])

    return by_small_batches(slim).mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int")


def with_copies(masked: DataFrame) -> DataFrame:
    """The masks with E: rows whose digest a smaller id has."""
    same = masked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).where("first_id < last_id").select("digest", "first_id", "n")
    found = with_hubs(masked, same, ["digest"], "n", masked.count(), "left")
    copied = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return found.select("doc_id", "part", (F.col("mask") + F.when(copied, BIT["E"]).otherwise(0)).alias("mask"))


def words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, good, toxic, word) of every row: its survival word, and whether it is labelled of quality or toxic."""
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    full = with_copies(written(masks(docs, id_col, text_col, part_col), "filter-masks"))
    word = F.element_at(F.array(*[F.lit(w).cast("long") for w in WORDS_OF_MASKS]), F.col("mask") + 1)
    label = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return full.join(marked, full["doc_id"] == marked["of"], "left").select("part", *label, word.alias("word"))


def positional_counts(found: np.ndarray) -> np.ndarray:
    """How many of these 32-bit words have each bit, by carry-save addition."""
    counts, weight, column = np.zeros(32, np.int64), 1, found.astype(np.uint32)
    while len(column):
        carries = []
        while len(column) > 2:
            third = len(column) // 3
            a, b, c, rest = column[:third], column[third : 2 * third], column[2 * third : 3 * third], column[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            column = np.concatenate([half ^ c, rest])
        counts += weight * ((column[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(0, dtype=np.int64)
        column, weight = np.concatenate(carries) if carries else column[:0], 2 * weight
    return counts


def survivors(found: DataFrame) -> DataFrame:
    """(part, of: an array of (subset, kept, good, toxic) by subset) of the words of all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").dictionary_encode()
            group = parts.indices.to_numpy().astype(np.int64) * 4 + batch.column("good").to_numpy() * 2 + batch.column("toxic").to_numpy()
            order = np.argsort(group, kind="stable")
            group, word = group[order], batch.column("word").to_numpy()[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            classes = group[cuts[:-1]]
            counts = np.concatenate([positional_counts(word[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            each = np.repeat(classes, 32)
            columns = [parts.dictionary.take(pa.array(each // 4)), pa.array(np.tile(np.arange(32, dtype=np.int32), len(classes))), pa.array(counts), pa.array(counts * (each // 2 % 2)), pa.array(counts * (each % 2))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "subset", "kept", "good", "toxic"])

    counted = found.mapInArrow(run, "part string, subset int, kept bigint, good bigint, toxic bigint")
    summed = counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])
    return summed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("of"))  # 32 a part


def steps() -> list[dict]:
    """Each order and step of all filters: the subsets before and with it, the filter's own, and all the others."""
    out = []
    for order in sorted(map("".join, permutations(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            out.append({"filter_order": order, "step": i + 1, "before": before, "after": before | BIT[f], "own": BIT[f], "others": ALL ^ BIT[f]})
            before |= BIT[f]
    return out


def _removed_in_all_orders(own: int) -> Column:
    """What a filter removes, summed over all orders: each subset before it counts as often as it can be ordered."""
    n = len(FILTERS)
    before = [s for s in range(ALL + 1) if not s & own]
    return sum(F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) * (F.col("of")[s]["kept"] - F.col("of")[s | own]["kept"]) for s in before)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    plan = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, before: int, after: int, own: int, others: int>>")
    own = F.array(*[_removed_in_all_orders(BIT[f]) for f in FILTERS])
    each = survivors(words(docs, labels, id_col, text_col, part_col)).withColumn("shares", own).select("part", "of", "shares", F.inline(plan))
    at = lambda subset, what: F.col("of")[F.col(subset)][what]
    removed = at("before", "kept") - at("after", "kept")
    lost = [(at("before", c) - at("after", c)).alias(f"{c}_lost") for c in ("good", "toxic")]
    fails = F.col("of")[0]["kept"] - at("own", "kept")
    share = F.element_at("shares", (F.round(F.log2("own")) + 1).cast("int"))
    unique = at("others", "kept") - F.col("of")[ALL]["kept"]
    return each.select("part", "filter_order", "step", at("after", "kept").alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"), unique.alias("unique_fails"), *lost, share.alias("shapley"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM split GROUP BY text
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), judged AS (
  SELECT s.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
      CASE WHEN 100 * (length(s.text) - length(regexp_replace(s.text, '[A-Z]', '', 'g'))) > 10 * length(s.text) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(s.text, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN coalesce(s.doc_id > f.first_id, false) THEN 'E' ELSE '' END) AS fails
  FROM split s JOIN firsts f ON s.text = f.text LEFT JOIN marks m ON s.doc_id = m.doc_id
), sums AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM judged GROUP BY part, fails
), orders(o, rest) AS (
  SELECT '', 'ABCDE' UNION ALL
  SELECT o || f, replace(rest, f, '') FROM orders, unnest(string_split(rest, '')) AS t(f) WHERE rest <> ''
), plan AS (
  SELECT o AS filter_order, step::INT AS step, o[step] AS f, o[1:step - 1] AS before FROM orders, range(1, 6) AS t(step) WHERE rest = ''
), each AS (
  SELECT s.part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failing, fails = f AS alone,
    len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone
  FROM plan, sums s
), counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
