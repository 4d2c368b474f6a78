"""SimHash near-duplicates: a byte-position index with count filtering, then exact verification.

A fingerprint is 8 bytes. Two that differ in at most 4 bits share at least 4 of the 8 positional bytes, so that is the
guaranteed minimum of matches. Tallying single positional bytes would emit about N*N/64 tallies for N fingerprints,
so postings are keyed by three positional bytes at once: the 20 triples of `TRIPLES` are such that any four positions
contain one of them, hence every pair that reaches the minimum meets in at least one posting list. Inside a list the
shared positional bytes of each pair are tallied, pairs below the minimum go, and only the rest are verified by their
bits. The filter is a necessary condition of a link: it saves verifications and changes no result.

Work is done on distinct fingerprints, so exact copies cost nothing. A posting list emits the edges of a spanning
forest of its links, not all pairs: the components are the same. A list longer than `list_limit` is not sent to one
task: its members are dealt anew by further positions (a fourth byte, then nibbles), each step again by a family that
no linked pair escapes, down to lists that at most 2^16 distinct fingerprints can share.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows each get a
row; a null doc_id gets the fingerprint of its text and takes no part in the choice of the smallest id (component_id
is null if all ids of a component are null); equal ids with other texts are other documents; a very long text is
hashed whole, 16,384 shingles at a time; other columns of any name are ignored, and `one_of_each` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import by_small_batches, fresh_name, kept, slices, written
from inkwell.operators.graph import components, with_hubs

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
MIN_SHARED = 8 - MAX_BITS
LIST_LIMIT = 2048


def covering_triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions such that any 4 positions contain one: whole parts, and two of a part with one of the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [parts[0], parts[1]]
    for i, part in enumerate(parts):
        out += [tuple(sorted((*two, one))) for two in combinations(part, 2) for one in parts[(i + 1) % 3]]
    return sorted(out)


TRIPLES = covering_triples()


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of one text: a bit is 1 if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return digest(flat, SEED)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.r_[0, gaps + 1][: len(words) - SHINGLE_WORDS + 1].tolist()
    ends = np.r_[gaps, len(flat)][SHINGLE_WORDS - 1 :].tolist()
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at : at + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print: a hash of the text as it is, fp long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("print"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "print", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return by_small_batches(slim).mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, print bigint, fp bigint")


def _bits(fp: Column, places: Iterable[int], width: int) -> Column:
    """The bits at these places (units of `width` from the top) side by side."""
    out = F.lit(0).cast("long")
    for p in places:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, 64 - width * (p + 1)).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def posted(fps: DataFrame) -> DataFrame:
    """One posting for each covering triple of positional bytes: (list: which triple, key: its bytes, fp)."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("list"), _bits(F.col("fp"), t, 8).alias("key")) for i, t in enumerate(TRIPLES)])
    return fps.select(F.inline(each), "fp")


def finer_places(step: int) -> list[tuple[int, int, list[int]]]:
    """(list, finer list, places): what a list's members may further share; a list's number holds every choice so far.

    Step 1: one more equal byte of the other five. Step 2: three equal nibbles of the remaining eight, by the same
    covering triples, as at most 4 of the 8 differ. Step 3: one more equal nibble of the remaining five.
    """
    out = []
    for i, triple in enumerate(TRIPLES):
        others = [p for p in range(8) if p not in triple]
        for j, p in enumerate(others):
            second = i * 5 + j
            if step == 1:
                out.append((i, second, [p]))
                continue
            nibbles = [n for q in others if q != p for n in (2 * q, 2 * q + 1)]
            for k, t in enumerate(TRIPLES):
                third = second * 20 + k
                if step == 2:
                    out.append((second, third, [nibbles[n] for n in t]))
                    continue
                left = [n for y, n in enumerate(nibbles) if y not in t]
                out += [(third, third * 5 + m, [n]) for m, n in enumerate(left)]
    return out


def dealt_anew(hot: DataFrame, step: int) -> DataFrame:
    """Postings of too long lists under finer keys that no linked pair escapes."""
    width = 8 if step == 1 else 4
    plan = hot.sparkSession.createDataFrame(finer_places(step), "list long, finer long, places array<int>")
    more = f"aggregate(places, key, (k, p) -> shiftleft(k, {width}) | (shiftrightunsigned(fp, {64 - width} - {width} * p) & {(1 << width) - 1}L))"
    return hot.join(F.broadcast(plan), "list").select(F.col("finer").alias("list"), F.expr(more).alias("key"), "fp")  # at most 10,000 rows, whatever the data


def linked(many: np.ndarray, other: np.ndarray | np.uint64) -> np.ndarray:
    """Where these fingerprints link with the other ones: tally the shared positional bytes, then verify what is left."""
    differ = many ^ other
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    enough = np.flatnonzero(shared >= MIN_SHARED)
    return enough[np.bitwise_count(differ[enough]) <= MAX_BITS]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest that connects what is linked among these distinct fingerprints.

    A search through the list: each member in turn tallies the positional bytes it shares with those not yet reached,
    keeps those that reach the guaranteed minimum, and verifies their bits.
    """
    left, edges, todo = np.arange(len(fps)), [], []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        i = todo.pop()
        at = linked(fps[left], fps[i])
        found = left[at].tolist()
        edges += [(i, j) for j in found]
        todo += found
        left = np.delete(left, at)
    return edges


def list_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside posting lists; rows come sorted by (list, key), and a list may span batches."""
    kept("simhash")
    rest: list[np.ndarray] = []

    def links(number: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.r_[0, np.flatnonzero((np.diff(number) != 0) | (np.diff(key) != 0)) + 1, len(fp)]
        sizes, a, b = np.diff(cuts), [], []
        two = cuts[:-1][sizes == 2]
        near = linked(fp[two], fp[two + 1])
        a.append(fp[two][near])
        b.append(fp[two + 1][near])
        for at, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fp[at : at + n]
            if edges := forest(own):
                x, y = np.array(edges).T
                a.append(own[x])
                b.append(own[y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("list", "key", "fp")]
        if rest:
            cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
        number, key, fp = cols
        if not len(fp):
            continue
        last = np.flatnonzero((number != number[-1]) | (key != key[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(number[:cut], key[:cut], fp[:cut].view(np.uint64))
        rest = [c[cut:].copy() for c in cols]
    if rest:
        yield links(rest[0], rest[1], rest[2].view(np.uint64))


def links(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links of at most 4 bits."""
    found = None
    lists = posted(fps)
    for step in range(1, 5):
        cold = lists
        hot = None
        if step < 4:
            long = written(lists.groupBy("list", "key").count().where(F.col("count") > list_limit).select("list", "key"), "long-lists")
            if long.limit(1).count():
                cold = lists.join(long, ["list", "key"], "left_anti")
                hot = written(lists.join(long, ["list", "key"], "left_semi"), "long-postings")
        ordered = cold.repartition("list", "key").sortWithinPartitions("list", "key")
        edges = ordered.mapInArrow(lambda it: local_forest(list_links(it)), "a bigint, b bigint")  # one worker a task
        found = edges if found is None else found.unionByName(edges)
        if hot is None:
            return found
        lists = dealt_anew(hot, step)
    return found


def local_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a batch without those that close a circle."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(i: int, up: dict = up) -> int:
            while up.setdefault(i, i) != i:
                up[i] = i = up[up[i]]
            return i

        a, b = [], []
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            r, s = root(x), root(y)
            if r != s:
                up[max(r, s)] = min(r, s)
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """(doc_id, print, fp, root, component_id) of every row; root numbers the component."""
    signed = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    edges = written(links(fps.select("fp"), list_limit), "links")
    roots = components(edges)
    tree = written(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "trees")
    smallest = tree.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of_root"))
    known = with_hubs(tree, smallest, ["root"], "of_root", tree.count()).select("fp", "root", "component_id", "n")
    known = written(known, "known-fingerprints")
    return with_hubs(signed, known, ["fp"], "n", signed.count()).select("doc_id", "print", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The given rows without near-duplicates: of each component the row of the smallest id stays.

    Choices are made on (doc_id, print) alone, by an aggregation that survives a component with most rows; null ids
    come last, equal ids are ordered by the text's hash, and of wholly equal rows one stays.
    """
    found = written(near_duplicates(docs, id_col, text_col), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print")).alias("first")
    of, mark = fresh_name("chosen", docs.columns), fresh_name("mark", docs.columns)
    chosen = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias(of), F.col("first.print").alias(mark))
    many = found.groupBy("doc_id", "print").count().where("count > 1")
    repeated = chosen.join(many, chosen[of].eqNullSafe(many["doc_id"]) & (chosen[mark] == many["print"]), "left_semi")
    same = F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(mark))
    kept = docs.join(chosen, same, "left_semi")
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
