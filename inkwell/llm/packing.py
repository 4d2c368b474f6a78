"""Packing documents into sequences of a fixed length, neighbours along a space-filling curve together.

Each text is encoded and its token counts are hashed into a vector of VECTOR places (square roots, unit length), which a
fixed random matrix projects to AXES coordinates in (0, 1), cut to BITS bits. The Hilbert key of that point is the
document's place on the curve: points near on the curve are near in space, so documents of like vocabulary come next to
each other. Documents are range-sorted by key; the stream of all their tokens in this order is cut at every `length`
tokens, and what is left at its end into powers of two, which need no padding. So no sequence is padded at all.

A text is cut into words where a match of the tokenizer's pattern is sure to end (white space; between ASCII letters, digits
and marks), each distinct word of a batch is encoded once, and a worker keeps those it has met (MOST_WORDS, then anew).
Tokens are written once (two bytes each, if the vocabulary allows) and shuffled once. Positions come in two steps: the
narrow rows (key, tie, number) are range-partitioned, and the driver gets one row a partition, its least key and its sum of
tokens; then the tokens go to the same ranges, are sorted there, and every document's start is its range's start and what
lies before it. Equal keys, as copies have, are ordered by a hash of id and tokens and then by row number, so a large group
of copies is spread over many ranges.

Defined results: a null or empty text has only the closing id; repeated rows each get their pieces; a null id is kept; a
text of any length is encoded whole and cut over as many sequences as it takes; strings of special tokens in a text are
ordinary text; with no rows there are no pieces; other columns of any name are ignored. The order does not depend on how
the input is partitioned.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.llm.common import by_small_batches, kept, slices, written

LENGTH, END_ID = 2048, 1
VECTOR, AXES, BITS, SEED = 1024, 4, 12, 20_48
MOST_WORDS, GROUP_BYTES = 2_000_000, 8_000_000

_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)  # bytes of other characters, and the apostrophe, which may begin a match
    for b in range(33, 127):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    kinds[ord("'")] = _OTHER
    kinds[[32, *range(9, 14)]] = _SPACE
    return kinds


def _byte_cuts() -> np.ndarray:
    """Which kinds of neighbouring bytes never lie in one match: a word begins after white space, or at a change of kind."""
    cuts = np.zeros((5, 5), bool)
    cuts[_SPACE, _LETTER:] = True
    for kind in (_LETTER, _DIGIT, _MARK):
        cuts[kind, _LETTER:_OTHER] = True
        cuts[kind, kind] = kind == _DIGIT
    return cuts.ravel()


KINDS, CUTS = _byte_kinds(), _byte_cuts()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32


class Encoder:
    """Ids of texts by a tokenizer that composes and lower-cases, and matches runs of letters, single digits and runs of marks."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.matches = regex.compile(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.plain = re.compile("[!-~¡-įı-ɏ]+").fullmatch
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.printable = {b: 256 + i for i, b in enumerate(hidden)}  # bytes as the byte-level step writes them
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.starts, self.flat = np.zeros(1, np.int32), np.zeros(0, self.type)

    def ids_of(self, word: str) -> list[int]:
        """The ids of a word; one of Latin characters, which no normal form changes, is cut and merged without other steps."""
        bare = word.rstrip(" ")
        if bare.isascii() and bare.isalpha():
            return [t.id for t in self.merge(bare)]
        if self.plain(bare):
            return [t.id for m in self.matches(bare.lower()) for t in self.merge(m.encode().decode("latin-1").translate(self.printable))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def numbers(self, words: pa.StringArray) -> np.ndarray:
        """The number of each distinct word among those known; new ones are encoded and become known."""
        if len(self.words) + len(words) > MOST_WORDS:
            self.clear()
        places = pc.index_in(words, value_set=self.words)
        new = words.filter(places.is_null())
        out = places.fill_null(-1).to_numpy().copy()
        out[out < 0] = np.arange(len(self.words), len(self.words) + len(new))
        found = [self.ids_of(w) for w in new.to_pylist()]
        self.words = pa.concat_arrays([self.words, new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(f) for f in found], dtype=np.int32)])
        self.flat = np.concatenate([self.flat, np.fromiter((i for f in found for i in f), self.type)])
        return out

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's begin and the last one's end), each text closed by the end id."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds = KINDS[raw]
        cut = np.empty(len(raw) + 1, bool)
        cut[1:-1] = CUTS[kinds[:-1] * 5 + kinds[1:]]
        cut[offsets] = True
        begin = np.flatnonzero(cut).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(LOWER[raw])).dictionary_encode()
        number = self.numbers(words.dictionary)
        first, size = self.starts[number], self.starts[number + 1] - self.starts[number]
        each = words.indices.to_numpy()
        sizes = size[each]
        ends = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        ids = self.flat[np.repeat(first[each] - ends[:-1], sizes) + np.arange(ends[-1], dtype=np.int32)]
        bounds = ends[np.searchsorted(begin[:-1], offsets)].astype(np.int64)
        return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole numbers under 2^bits, all rows at once.

    By Skilling's transposition: from the highest bit down, undo each axis's exchange or reversal, then the Gray code.
    """
    x = points.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            turned = (x[i] >> b) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> b) & 1)
    return key


def places_of(ids: np.ndarray, bounds: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text of these ids: its hashed vector, projected."""
    hashed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)  # the upper bits of a golden-ratio product: under 1024
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    vectors = np.sqrt(np.bincount(text * VECTOR + hashed % VECTOR, minlength=n * VECTOR).reshape(n, VECTOR))
    vectors /= np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-12)
    inside = 1 / (1 + np.exp(-1.7 * vectors @ projection))
    return hilbert_keys(np.minimum(inside * (1 << BITS), (1 << BITS) - 1).astype(np.int64))


def groups(batches: Iterable[pa.RecordBatch], text_col: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `size` bytes of text (or one row), whatever batches they came in."""
    some: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        for piece in slices(batch, text_col, size):
            n = pc.sum(pc.binary_length(piece.column(text_col))).as_py() or 0
            if some and total + n > size:
                yield pa.concat_batches(some)
                some, total = [], 0
            some.append(piece)
            total += n
    if some:
        yield pa.concat_batches(some)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, key, ids: little-endian bytes, tie, number) of every row, written; number is the row's own."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("packing", path, lambda: Encoder(path))
        projection = np.random.default_rng(SEED).standard_normal((VECTOR, AXES))
        for group in groups(batches, "text", GROUP_BYTES):
            ids, bounds = encoder.encode(group.column("text"), end_id)
            offsets = pa.py_buffer((bounds * encoder.type.itemsize).astype(np.int32))
            bytes_ = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(ids.astype(encoder.type))])
            yield pa.RecordBatch.from_arrays([group.column("doc_id"), pa.array(np.diff(bounds)), pa.array(places_of(ids, bounds, projection)), bytes_], ["doc_id", "n", "key", "ids"])

    found = by_small_batches(slim).mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n bigint, key bigint, ids binary")
    return written(found.select("*", F.xxhash64("doc_id", "ids").alias("tie"), F.monotonically_increasing_id().alias("number")), "packing-tokens")


ORDER = ["key", "tie", "number"]


def ranges(rows: DataFrame, parts: int) -> list[tuple[tuple[int, int, int], int, int]]:
    """(least order, tokens before, tokens) of the ranges of the curve, in order: one row a partition."""
    dealt = rows.select(*ORDER, "n").repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id())
    found = sorted((tuple(r["least"]), r["tokens"]) for r in dealt.groupBy("part").agg(F.min(F.struct(*ORDER)).alias("least"), F.sum("n").alias("tokens")).collect())
    before = np.cumsum([0, *[n for _, n in found]]).tolist()
    return [(least, at, n) for (least, n), at in zip(found, before, strict=False)]


def sequences_from(total: int, length: int) -> list[tuple[int, int]]:
    """(first position, length) of the sequences after the last full one: powers of two, the largest first."""
    at, out = total // length * length, []
    for b in range(length.bit_length(), -1, -1):
        if (total - at) >> b:
            out.append((at, 1 << b))
            at += 1 << b
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids are little-endian 32-bit numbers.

    `parts` ranges of the curve are sorted each on its own: as many as the session has shuffle partitions.
    """
    rows = encoded(docs, path, end_id, id_col, text_col)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ranges(rows, parts)  # a row a partition reaches the driver, whatever the data
    firsts, befores = [f for f, _, _ in found], [b for _, b, _ in found]
    total = sum(n for _, _, n in found)
    full, tail = total // length, sequences_from(total, length)
    tail_starts = [at for at, _ in tail]

    @F.arrow_udf("int")
    def range_of(key: pa.Array, tie: pa.Array, number: pa.Array) -> pa.Array:
        each = zip(key.to_pylist(), tie.to_pylist(), number.to_pylist(), strict=True)
        return pa.array([bisect_right(firsts, x) - 1 for x in each], pa.int32())

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, position = None, 0
        for batch in batches:
            out: list[tuple] = []
            for own, doc, n, ids in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True):
                if own != part:
                    part, position = own, befores[own]
                raw = ids.as_buffer()
                flat = np.frombuffer(raw, np.dtype(f"<u{raw.size // n}")).astype("<u4")
                start = 0
                while start < n:
                    sequence, first, size = position // length, position // length * length, length
                    if sequence >= full:
                        i = bisect_right(tail_starts, position) - 1
                        sequence, (first, size) = full + i, tail[i]
                    taken = min(n - start, first + size - position)
                    out.append((doc, start, taken, flat[start : start + taken].tobytes(), n, sequence, position - first))
                    start, position = start + taken, position + taken
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    id_type = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    dealt = rows.withColumn("range", range_of(*ORDER)).repartitionById(parts, F.col("range")).sortWithinPartitions("range", *ORDER)
    return dealt.select("range", "doc_id", "n", "ids").mapInArrow(cut, f"doc_id {id_type.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, tokens, padded): whole sequences of the pieces, padded to `length` unless a power of two long."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("of"), F.sum("length").alias("tokens"))  # at most `length` pieces
    padded = F.when(F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0, F.col("tokens")).otherwise(F.lit(length).cast("long"))
    joined = F.aggregate("of", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    filling = F.unhex(F.repeat(F.lit(pad.to_bytes(4, "little").hex()), (F.col("padded") - F.col("tokens")).cast("int")))
    return whole.withColumn("padded", padded).select("sequence_id", F.concat(joined, filling).alias("ids"), "tokens", "padded")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
