"""Language identification by compression.

Each language has a zstandard raw-content dictionary: lines of that language, side by side. A text, in lower case and
with spaces for all but letters, is encoded block by block with every dictionary, and the language whose dictionary
gives the fewest bytes in all is chosen. If the runner-up is closer than `margin` (as a share of the bytes), the
document is rejected as undecided.

The dictionaries come from a bounded sample of the labelled rows (`dictionary_bytes` a language, from at most
`sample_rows` rows a language, spread by the hash of the id, and of each whole lines of least hash up to `row_chars` characters); predictions
read whole texts of every row, all at one compression level. Labelled rows also hold passages in other languages, so
each half of the sample is first cleaned with dictionaries of the other half: lines that another language encodes
better are left out, and so are lines under `shortest_line` bytes, which give no evidence of their language.

Defined results: `und` with score 0, rejected, for null texts and texts without a letter; with no labelled rows, every
row is `und`; equal sizes go to the language that comes first by code point; repeated rows each get a row; a very
long text is encoded in blocks of `BLOCK` bytes, each with the whole dictionary; other columns of any name are ignored,
and with `keep` returned in the struct `kept`, where they clash with nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import judged, kept, remainder, spread_sample

UNDECIDED = "und"
#: Bounds of the sample that the dictionaries are made of.
DICTIONARY_BYTES, SAMPLE_ROWS, ROW_CHARS, PIECE_CHARS, SHORTEST_LINE = 98_304, 200, 20_000, 2_000, 20
BLOCK = 8_192
LEVEL = 9
MARGIN = 0.0005
NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES, sample_rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS, shortest_line: int = SHORTEST_LINE) -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows.

    The rows of least hash are found from ids alone. Of rows that share id and language the least text stands for all.
    Of a chosen row the driver gets lines up to `row_chars` characters, those of least hash wherever they stand in the
    text; lines over PIECE_CHARS are cut at white space first.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where((F.length("text") > 0) & F.col("lang").isNotNull() & F.col("id").isNotNull())
    sample = spread_sample(known.select("id", "lang").distinct(), "lang", "id", "dictionary", sample_rows)
    own = (F.col("id") == F.col("chosen")) & (F.col("lang") == F.col("of_group"))
    texts = known.join(F.broadcast(sample), own).groupBy("lang", "place").agg(F.min("text").alias("text"))  # at most sample_rows a language
    pieces = F.regexp_extract_all("text", F.lit(rf"[^\n]{{1,{PIECE_CHARS}}}(?=\s|$)|[^\n]{{1,{PIECE_CHARS}}}"), F.lit(0))
    by_hash = Window.partitionBy("lang", "place").orderBy(F.xxhash64("piece"), "spot")
    rows = texts.select("lang", "place", F.posexplode(pieces).alias("spot", "piece")).withColumn("upto", F.sum(F.length("piece")).over(by_hash)).where(F.col("upto") <= row_chars)
    lines: dict[str, tuple[dict, dict]] = {}
    for of, rank_of, _, piece in sorted(rows.select("lang", "place", "spot", "piece").collect()):
        if x := normalised(piece):
            lines.setdefault(of, ({}, {}))[rank_of % 2][x] = None
    return cleaned(lines, dictionary_bytes, shortest_line)


def filled(lines: Iterable[bytes], size: int) -> bytes:
    out: list[bytes] = []
    for x in lines:
        if len(x) < size:
            out.append(x)
            size -= len(x) + 1
    return b"\n".join(out)


def cleaned(lines: dict[str, tuple[dict, dict]], size: int, shortest_line: int = SHORTEST_LINE) -> dict[str, bytes]:
    """Dictionaries of the lines that the other half's dictionaries give to the same language (all lines if none is left)."""
    kept: dict[str, list[bytes]] = {of: [] for of in lines}
    for half in (0, 1):
        judge = Coder(tuple(sorted((of, filled(both[1 - half], size)) for of, both in lines.items())))
        for of, both in lines.items():
            kept[of] += [x for x in both[half] if len(x) >= shortest_line and judge.names[min(range(len(judge.names)), key=judge.sizes(x).__getitem__)] == of]
    return {of: filled(kept[of] or [x for half in both for x in half], size) for of, both in lines.items() if any(both)}


class Coder:
    """Compressors with the dictionaries of all languages."""

    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...]):
        import regex
        import zstandard as z

        self.letter = regex.compile(r"\p{L}")
        self.names = [n for n, _ in dictionaries]
        self.coders = []
        for _, content in dictionaries:
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, raw: bytes) -> list[int]:
        """The encoded bytes of a whole text with each language's dictionary."""
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(code(b)) for b in blocks) for code in self.coders]

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected); the score is the saving over the runner-up, squeezed into 0 to 1."""
        if not text or not self.names or not self.letter.search(text):
            return UNDECIDED, 0.0, True
        sizes = self.sizes(normalised(text))
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.names[order[0]], 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        lead = (second - best) / max(1, second)
        return self.names[order[0]], lead / (lead + 0.02), lead < margin


def coder(dictionaries: tuple[tuple[str, bytes], ...]) -> Coder:
    """Kept by the worker process from task to task."""
    return kept("langid", dictionaries, lambda: Coder(dictionaries))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, and with `keep` its columns in a struct `kept`."""
    model = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def judge(texts: list) -> list[tuple]:
        return [coder(model.value).predict(t, margin) for t in texts]

    return judged(docs, judge, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())], id_col, text_col, keep)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 4) == 2


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = fit(docs.where(~held_out()))
    return identify(docs, dictionaries).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
