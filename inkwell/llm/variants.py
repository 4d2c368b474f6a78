"""Spelling variants: words one edit apart, found by finite-state composition, and each word's most frequent neighbour.

Pairs of near words are what the composition A ∘ T ∘ A accepts: A is the minimised acceptor of a vocabulary, T the
transducer that copies its input but for exactly one inserted, deleted or replaced code point. A state of it is (state of
A, edited or not, state of A); what cannot reach acceptance is trimmed, so every path that is walked ends in a pair.

No task holds the whole vocabulary: pairs are enumerated per initial state. Let c be the shorter length of a pair, and h
half of it, rounded down. An edit at place h or later leaves the first h code points equal, so both words leave the
acceptor's start by the same path and reach the same state; an earlier one leaves the last c - h equal, and the same holds
for the acceptor of the reversed words. So a word of m code points is posted under its first and last half for c = m and
c = m - 1, four postings a word, and for each (c, side, half) the acceptor of the rests is built, minimised and composed.
No pair is lost, and a pair that both sides could find is taken from the first. The halves grow with the words; how many
words share one depends on the language alone, not on how often they occur.

Defined results: a null text has no runs, a null id counts as the empty text in the hash; repeated rows count each; equal
counts are ordered by code point; with no words there are no rows; runs and texts of any length are taken whole; other
columns of any name are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import by_small_batches, kept, slices, written

#: Letters of a run, the divisor of altered runs, and what makes a word and a form.
RUN = "[A-Za-zÀ-ÿ]+"
ALTERED, LEAST_LETTERS, LEAST_COUNT, TIMES = 199, 6, 5, 5


def altered(run: str, start: int) -> str:
    """The lower-cased run; if ALTERED divides the hash of id and run, without the code point at the hash's place."""
    h = zlib.crc32(run.encode(), start)
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of every part of a batch: how often each run occurs there, altered where the hash of id and run says so."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = re.compile(RUN).findall

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("variants")
        for batch in batches:
            for piece in slices(batch, "text", 4_000_000):
                found: dict[str, int] = {}
                for name, text in zip(piece.column("doc_id").to_pylist(), piece.column("text"), strict=True):
                    start = zlib.crc32(f"{name}:".encode())
                    for r, n in Counter(runs(text.as_buffer().to_pybytes().lower().decode())).items():  # of bytes: A-Z only
                        if len(r) >= least_letters and len(w := altered(r, start)) >= least_letters:
                            found[w] = found.get(w, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return by_small_batches(slim).mapInArrow(run, "word string, n bigint")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough in all documents."""
    return occurrences(docs, id_col, text_col, least_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def postings(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(c: shorter length, behind: by the last half, half, word, n): under which initial states a word's rest is read."""
    m = F.length("word")

    def under(c: Column, behind: bool) -> Column:
        h = F.floor(c / 2).cast("int")
        half = F.substring(F.col("word"), m - (c - h) + 1, c - h) if behind else F.substring(F.col("word"), F.lit(1), h)
        return F.struct(c.alias("c"), F.lit(behind).alias("behind"), half.alias("half"))

    each = [F.when(c >= least_letters, under(c, behind)) for c in (m, m - 1) for behind in (False, True)]
    return words.select(F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())), "word", "n")


class Acceptor:
    """The minimal acyclic automaton of sorted distinct strings: arcs of each state, and whether it accepts."""

    def __init__(self, strings: Iterable[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.accepts = [False]
        self.same: dict[tuple, int] = {}
        path, last = [0], ""
        for s in strings:
            shared = next((i for i, (a, b) in enumerate(zip(s, last)) if a != b), min(len(s), len(last)))  # noqa: B905
            self._merge(path, last, shared)
            for letter in s[shared:]:
                self.arcs.append({})
                self.accepts.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.accepts[path[-1]] = True
            last = s
        self._merge(path, last, 0)

    def _merge(self, path: list[int], last: str, down_to: int) -> None:
        """States below this depth of the path are finished: each becomes the known state of the same future, if any."""
        while len(path) - 1 > down_to:
            state = path.pop()
            future = (self.accepts[state], *sorted(self.arcs[state].items()))
            self.arcs[path[-1]][last[len(path) - 1]] = self.same.setdefault(future, state)


def composed(a: Acceptor) -> dict[tuple, list[tuple]]:
    """The arcs of A ∘ T ∘ A that can lead to acceptance: state (left, right, edited) to (left letter, right letter, state)."""
    first = (0, 0, False)
    arcs: dict[tuple, list[tuple]] = {}
    into: dict[tuple, list[tuple]] = {}
    todo, ends = [first], []
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        p, q, edited = state
        left, right = a.arcs[p], a.arcs[q]
        out = [(x, x, (left[x], right[x], edited)) for x in left.keys() & right.keys()]
        if not edited:  # then p is q
            out += [(x, y, (left[x], right[y], True)) for x in left for y in right if x != y]
            out += [("", y, (p, right[y], True)) for y in right] + [(x, "", (left[x], q, True)) for x in left]
        elif a.accepts[p] and a.accepts[q]:
            ends.append(state)
        arcs[state] = out
        for _, _, to in out:
            into.setdefault(to, []).append(state)
            todo.append(to)
    alive = set()
    while ends:
        state = ends.pop()
        if state not in alive:
            alive.add(state)
            ends += into.get(state, [])
    return {s: [arc for arc in arcs[s] if arc[2] in alive] for s in alive}


def near_pairs(strings: list[str]) -> set[tuple[str, str]]:
    """All pairs of these strings that differ by exactly one edit, in both orders."""
    a = Acceptor(sorted(strings))
    machine = composed(a)
    found, todo = set(), [((0, 0, False), "", "")] if machine else []
    while todo:
        (p, q, edited), left, right = todo.pop()
        if edited and a.accepts[p] and a.accepts[q]:
            found.add((left, right))
        todo += [(to, left + x, right + y) for x, y, to in machine[p, q, edited]]
    return found


def pairs_of_state(c: int, behind: bool, half: str, words: dict[str, int]) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near, near_n) for the words of one initial state; pairs of two longer words belong to another."""
    h, k = c // 2, len(half)
    whole = (lambda rest: rest[::-1] + half) if behind else (lambda rest: half + rest)
    for x, y in near_pairs([w[:-k][::-1] if behind else w[k:] for w in words]):
        u, v = whole(x), whole(y)
        if min(len(u), len(v)) == c and not (behind and u[:h] == v[:h]):
            yield u, words[u], v, words[v]


#: Pairs a batch.
PAIRS = 20_000


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n, near, near_n) of all pairs that differ by exactly one edit, in both orders; words: (word, n), distinct."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("variants")
        state, own, out = None, {}, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "near", "near_n"])

        for batch in batches:
            for *key, word, n in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if key != state:
                    if len(own) > 1:
                        out += pairs_of_state(*state, own)
                    state, own = key, {}
                    if len(out) >= PAIRS:
                        yield batch_of()
                        out = []
                own[word] = n
        if len(own) > 1:
            out += pairs_of_state(*state, own)
        yield batch_of()

    dealt = postings(words, least_letters).repartition("c", "behind", "half").sortWithinPartitions("c", "behind", "half")
    return dealt.mapInArrow(run, "word string, n bigint, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, in doubled steps; counts grow, so none goes in circles."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while at.join(at.select(F.col("word").alias("root")), "root", "left_semi").limit(1).count():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    The form is the near word of largest n, if that is at least `times` the word's own n.
    """
    words = written(vocabulary(docs, id_col, text_col, least_letters, least_count), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words, least_letters).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    often = -F.col("best.less") >= times * F.col("n")
    near = written(near.select("word", "n_near", F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "near-words")
    last = roots(near.where("form is not null"))
    return words.join(near, "word", "left").join(last, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Runs have code points under 256 only, so a code point is one byte of UTF-8 or two.
OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) AS t(i))
), found AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+') AS runs FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(runs) AS run FROM found) GROUP BY ALL
), long AS (
  SELECT doc_id, run, n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)::BIGINT) AS points
  FROM lowered WHERE length(run) >= 6
), hashed AS (
  SELECT run, n, xor(list_reduce(flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END)),
    lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM long, steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), dropped AS (
  SELECT word, n, i, left(word, i::INT) || chr(1) || substr(word, i::INT + 2) AS hole, left(word, i::INT) || substr(word, i::INT + 2) AS short
  FROM words, unnest(range(length(word))) AS t(i)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM dropped a JOIN dropped b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM dropped a JOIN words b ON a.short = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM dropped a JOIN words b ON a.short = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), ways(word, spot, steps) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT w.word, f.form, w.steps + 1 FROM ways w JOIN forms f ON w.spot = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM forms f JOIN (SELECT word, arg_max(spot, steps) AS root FROM ways GROUP BY word) r ON f.word = r.word
"""
