"""Byte-level BPE encoding and decoding with DuckDB inside Spark tasks.

Every task cuts its documents into words with the tokenizer's pattern, keeps the distinct words it has not met yet,
and hands them to one recursive DuckDB query: rows (spot = word and position, token, rank of the pair that starts here)
join the merge table, and each turn contracts the leftmost pair of least rank of every word until no pair is left. The
recursion is keyed by spot, so it holds one row a byte however many turns a word takes.
Decoding unnests the ids with their positions, joins the vocabulary, and concatenates by an ordered aggregation.
There is no shuffle; memory is bounded by the word cache and by the size of the groups handed to DuckDB.

Defined results: a null or empty text has no ids, n_tokens 0 and decodes to zero bytes; ids outside the vocabulary
raise an error; columns of the input other than the id and the text are passed through `encode` untouched.
Words that are whole tokens need no turn. Words of more than LONG_WORD bytes (a ruled line, a paragraph without spaces)
contract all occurrences of their least pair in a turn, so their turns are about as many as the different pairs they
contract, not as many as their bytes: 100,000 dashes take 0.6 s, 33,000 Chinese letters of 18 kinds 3 s, 3,000 random
letters 3 s, 100,000 random letters 112 s; memory grows with the word. Ranks are distinct, so pairs of equal rank are equal
pairs, and the leftmost comes first. An empty table has no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from inkwell.llm.common import by_small_batches, fresh_name, kept, slices, with_fields

CACHE = 400_000
GROUP_BYTES = 4_000_000
DECODE_TOKENS = 400_000
WORD_BYTES = 600_000
LONG_WORD = 256

MERGE_SQL = """
WITH RECURSIVE s(spot, tok, rank, live) USING KEY (spot) AS (
  SELECT spot, tok, rank, true FROM start
  UNION ALL
  SELECT n.spot, CASE WHEN NOT n.gone THEN n.tok END, m.rank, n.hit IS NOT NULL AND NOT n.gone
  FROM (
    SELECT spot, hit, coalesce(spot0 = hit, false) AS gone, CASE WHEN spot = hit THEN merged ELSE tok END AS tok,
      CASE WHEN spot = hit THEN next2 WHEN spot1 = hit THEN merged ELSE next1 END AS nxt
    FROM (
      SELECT r.spot, tok, spot0, spot1, CASE WHEN (spot1 >> 32) = (r.spot >> 32) THEN next1 END AS next1,
        CASE WHEN (spot2 >> 32) = (r.spot >> 32) THEN next2 END AS next2,
        (w << 32) | (best & 4294967295) AS hit, (best >> 32)::INTEGER AS merged
      FROM (
        SELECT spot, tok, lag(spot) OVER o AS spot0, lead(spot) OVER o AS spot1, lead(spot, 2) OVER o AS spot2,
          lead(tok) OVER o AS next1, lead(tok, 2) OVER o AS next2
        FROM s WHERE live WINDOW o AS (ORDER BY spot)
      ) r LEFT JOIN (
        SELECT spot >> 32 AS w, min((rank::BIGINT << 32) | (spot & 4294967295)) AS best FROM s WHERE live GROUP BY 1
      ) b ON b.w = (r.spot >> 32)
    )
  ) n LEFT JOIN merges m ON m.pair = ((n.tok::BIGINT << 32) | n.nxt)
)
SELECT spot >> 32 AS w, tok FROM s WHERE tok IS NOT NULL ORDER BY spot
"""
#: The same fixpoint for long words: a turn contracts, left to right, every occurrence of the word's least pair that overlaps
#: none before it, up to the first one that makes a pair of still lower rank; rows are linked to their next one (nxt).
MERGE_LONG_SQL = """
WITH RECURSIVE s(spot, tok, nxt, rank) USING KEY (spot) AS (
  SELECT spot, tok, nxt, rank FROM start
  UNION ALL
  (WITH hits AS (
    SELECT r.spot, r.nxt, n.nxt AS nxt2, least
    FROM recurring.s r JOIN (SELECT spot >> 32 AS w, min(rank) AS least FROM recurring.s WHERE rank IS NOT NULL GROUP BY 1) b ON b.w = r.spot >> 32 AND b.least = r.rank
      JOIN recurring.s n ON n.spot = r.nxt
  ), chained AS (
    SELECT *, row_number() OVER o AS place, lag(nxt, 1, -1) OVER o = spot AS onto FROM hits WINDOW o AS (ORDER BY spot)
  ), apart AS (
    SELECT h.spot, h.nxt, nxt2, least, z.tok AS next2, p.spot AS spot0, p.tok AS prior
    FROM (SELECT *, place - max(CASE WHEN NOT onto THEN place END) OVER (ORDER BY spot) AS nth FROM chained) h
      LEFT JOIN recurring.s z ON z.spot = h.nxt2 LEFT JOIN recurring.s p ON p.nxt = h.spot
    WHERE nth % 2 = 0
  ), stops AS (
    SELECT f.spot >> 32 AS w, min(f.spot) AS stop
    FROM (SELECT *, count(*) OVER (PARTITION BY spot >> 32) AS many, CASE WHEN lag(nxt2) OVER o = spot THEN least ELSE prior END AS before FROM apart WINDOW o AS (ORDER BY spot)) f
      LEFT JOIN merges a ON a.pair = (f.before::BIGINT << 32) | f.least LEFT JOIN merges z ON z.pair = (f.least::BIGINT << 32) | f.next2
    WHERE many > 1 AND (a.rank < least OR z.rank < least) GROUP BY 1
  ), taken AS (
    SELECT spot, nxt, nxt2, least, spot0, prior, coalesce(lag(nxt2) OVER o = spot, false) AS touches, CASE WHEN lead(spot) OVER o = nxt2 THEN least ELSE next2 END AS next2
    FROM apart LEFT JOIN stops ON w = spot >> 32 WHERE stop IS NULL OR spot <= stop WINDOW o AS (ORDER BY spot)
  ), changed AS (
    SELECT spot, least AS tok, nxt2 AS nxt, (least::BIGINT << 32) | next2 AS pair FROM taken
    UNION ALL SELECT spot0, prior, spot, (prior::BIGINT << 32) | least FROM taken WHERE spot0 IS NOT NULL AND NOT touches
    UNION ALL SELECT nxt, NULL, NULL, NULL FROM taken
  )
  SELECT c.spot, c.tok, c.nxt, m.rank FROM changed c LEFT JOIN merges m ON m.pair = c.pair)
)
SELECT spot >> 32 AS w, tok FROM s WHERE tok IS NOT NULL ORDER BY spot
"""
DECODE_SQL = """
SELECT doc, list(v.piece ORDER BY spot) AS pieces
FROM flat JOIN vocab v ON v.id = flat.id GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> bytes:
    """The rank file's content; it is small and goes to the tasks with the function."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Kept(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and hits move up from there."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        self[key] = value = self.old[key]
        return value

    def unknown(self, keys: set) -> set:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return keys.difference(self.keys()).difference(self.old.keys())


class Codec:
    """One worker's DuckDB connection with the merge and vocabulary tables, and its cache of encoded words."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb
        import regex

        self.pattern, self.ranks = regex.compile(pattern), parse_ranks(content)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        ranks, pair, rank = self.ranks, [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    pair.append(x << 32 | y)
                    rank.append(r)
        self.first = np.full(65536, -1, np.int32)
        for b, r in ranks.items():
            if len(b) == 2:
                self.first[b[0] << 8 | b[1]] = r
        self.text = [str(i) for i in range(max(ranks.values()) + 1)]
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": "250MB"})
        self._table("merges", {"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int32())})
        self._table("vocab", {"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())})
        self.words = Kept(CACHE)

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _query(self, name: str, columns: dict, sql: str) -> pa.Table:
        self.con.register(name, pa.table(columns))
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return out

    def merge_by_sql(self, words: list[bytes], long: bool = False) -> list[bytes]:
        """The ids of each word as raw integers, by the recursive query (that of long words)."""
        length = np.array([len(b) for b in words])
        start = np.cumsum(length) - length
        raw = np.frombuffer(b"".join(words), np.uint8)
        spot = np.repeat((np.arange(len(words)) << 32) - start, length) + np.arange(len(raw))
        rank = np.r_[self.first[raw[:-1].astype(np.int32) << 8 | raw[1:]], -1]
        last = np.zeros(len(raw), bool)
        last[start + length - 1] = True
        rank[last] = -1
        links = {"nxt": pa.array(spot + 1, mask=last)} if long else {}
        out = self._query("start", {"spot": spot, "tok": self.byte[raw], "rank": pa.array(rank, mask=rank < 0), **links}, MERGE_LONG_SQL if long else MERGE_SQL)
        w, ids = out["w"].to_numpy(), out["tok"].to_numpy().astype(np.int32).tobytes()
        cuts = [0, *((np.flatnonzero(np.diff(w)) + 1) * 4).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def learn_words(self, words: Iterable[str]) -> None:
        known = self.words
        kinds: tuple[list, list] = ([], [])
        for w in words:
            b = w.encode()
            r = self.ranks.get(b)
            if r is not None:
                known[w] = np.int32(r).tobytes()
            else:
                kinds[len(b) > LONG_WORD].append((w, b))
        for long, todo in enumerate(kinds):
            self.learn(todo, bool(long))

    def learn(self, todo: list[tuple[str, bytes]], long: bool) -> None:
        """Encodes these words, WORD_BYTES (or one word) to a query."""
        at = 0
        while at < len(todo):
            end, size = at, 0
            while end < len(todo) and (size < WORD_BYTES or end == at):
                size += len(todo[end][1])
                end += 1
            for (w, _), ids in zip(todo[at:end], self.merge_by_sql([b for _, b in todo[at:end]], long), strict=True):
                self.words[w] = ids
            at = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        self.learn_words(self.words.unknown(set().union(*cut)))
        look = self.words.__getitem__
        return [np.frombuffer(b"".join(map(look, x)), np.int32) for x in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each document, DECODE_TOKENS ids (or one document) to a query."""
        out: list[bytes] = []
        while len(out) < len(ids):
            at, end, n = len(out), len(out), 0
            while end < len(ids) and (end == at or n + len(ids[end]) <= DECODE_TOKENS):
                n += len(ids[end])
                end += 1
            out += self.decode_by_sql(ids[at:end])
        return out

    def decode_by_sql(self, ids: list[np.ndarray]) -> list[bytes]:
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids)
        if not len(flat):
            return [b""] * len(ids)
        got = self._query("flat", {"doc": np.repeat(np.arange(len(ids), dtype=np.int32), length), "spot": np.arange(len(flat)), "id": flat}, DECODE_SQL)
        pieces = got["pieces"].combine_chunks()
        whole, cuts = pieces.values.cast(pa.large_binary()), pieces.offsets.to_numpy()
        ends = np.frombuffer(whole.buffers()[1], np.int64)
        if len(whole) != len(flat):
            raise ValueError("ids that are not in the vocabulary")
        data, out = whole.buffers()[2], [b""] * len(ids)
        for doc, a, b in zip(got["doc"].to_pylist(), ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist(), strict=True):
            out[doc] = data[a:b].to_pybytes()
        return out


def codec(content: bytes, pattern: str) -> Codec:
    """Kept by the worker process from task to task."""
    return kept("bpe", (content, pattern), lambda: Codec(content, pattern))


def encode_batches(batches: Iterable[pa.RecordBatch], content: bytes, pattern: str, text_col: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text_col, GROUP_BYTES):
            ids = codec(content, pattern).encode(part.column(text_col).to_pylist())
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids_col])


def as_lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    return [values[a:b] if v else np.empty(0, np.int32) for a, b, v in zip(offsets[:-1], offsets[1:], valid, strict=True)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The given rows with their token ids (array of int); a column that is already named so is replaced."""
    content, rest = read_ranks(ranks_path), docs.drop(ids_col)
    return by_small_batches(rest).mapInArrow(lambda it: encode_batches(it, content, pattern, text_col, ids_col), with_fields(rest.schema, (ids_col, T.ArrayType(T.IntegerType()))))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The given rows with the bytes that their ids stand for; null ids are no ids."""
    content, rest = read_ranks(ranks_path), encoded.drop(bytes_col)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = codec(content, pattern).decode(as_lists(b.column(ids_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, bytes_col])

    return by_small_batches(rest).mapInArrow(run, with_fields(rest.schema, (bytes_col, T.BinaryType())))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes every text, decodes the ids again, and returns the id with n_tokens and the digests of ids and bytes.

    Both halves run in one pass over the data, so the ids stay in the task. Repeated rows give repeated rows.
    """
    content = read_ranks(ranks_path)
    ids_col = fresh_name("ids", docs.columns)
    slim = docs.select(id_col, text_col, *keep)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encode_batches(it, content, pattern, text_col, ids_col):
            lists = as_lists(b.column(ids_col))
            kit = codec(content, pattern)
            ids_sha = [hashlib.sha256(",".join(map(kit.text.__getitem__, x.tolist())).encode()).hexdigest() for x in lists]
            sha = [hashlib.sha256(x).hexdigest() for x in kit.decode(lists)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([len(x) for x in lists], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(sha, pa.string()), *[b.column(k) for k in keep]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    schema = T.StructType([T.StructField("doc_id", slim.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *[slim.schema[k] for k in keep]])
    return by_small_batches(slim).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
