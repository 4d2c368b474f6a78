"""Media columns: content-addressed payloads in tar shards.

Payloads are kept as PNG images of 8-bit grey samples, 64 to a row, in tar shards in the shared folder. Each task
writes one shard and stores a payload once, under the digest of its stored form; a row carries only digest, shard,
offset and length. Metadata columns come from range reads of the header alone (33 bytes); whole payloads are read back
only by what needs the samples. A catalogue picks one place for each digest over all shards, so every row with equal
content refers to the same bytes.

A shard's name holds the task attempt, and the rows that refer to it are written as a Parquet table at once: a lost or
repeated task leaves at most an unreferenced shard behind, and later losses never lead to a second store.

Rows meet their content's columns by digest; digests that very many rows have (the empty text's, say) are salted.

Defined results: a null or empty text is a payload of 64 zero bytes with n_bytes 0; repeated rows each get a row; a
null doc_id is kept; an empty table gives no rows and no shard; equal texts refer to one place, the first by shard and
offset; a text of any length is one payload, which a task holds in memory; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import by_small_batches, new_path, slices, written
from inkwell.operators.graph import HUBS

WIDTH = 64
HEADER = 33
MAGIC = b"\x89PNG\r\n\x1a\n"
LEVEL = 5
SHARD_BYTES = 512 << 20
#: A digest with over a HUBS-th of the rows is joined in SALTS parts.
SALTS = 64


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return text + bytes(WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload as an image of 8-bit grey samples; its length is a multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter byte (0: none) before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    width, height, _ = png_header(media)
    at, data = HEADER, []
    while at < len(media):
        size = struct.unpack(">I", media[at : at + 4])[0]
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def file_system(uri: str):  # noqa: ANN201
    """(file system, path) of the folder; made in the task, with whatever store the folder's scheme names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shard:
    """A tar file in the making; `add` returns (offset, length) of a member's bytes."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.tar"
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        self.file = store.open_output_stream(f"{path}/{self.name}")
        self.size, self.places = 0, {}

    def add(self, digest: str, media: bytes) -> tuple[int, int]:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.file.write(head)
            self.file.write(media)
            self.file.write(bytes(-len(media) % 512))
            self.places[digest] = (self.size + len(head), len(media))
            self.size += len(head) + len(media) + -len(media) % 512
        return self.places[digest]

    def close(self) -> None:
        self.file.write(bytes(1024))
        self.file.close()


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text's payload to tar shards in the folder; (doc_id, n_bytes, digest, shard, offset, length)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for part in slices(batch, text_col, 8_000_000):
                out = []
                for x in part.column(text_col):
                    text = x.as_buffer().to_pybytes() if x.is_valid else b""
                    media = to_png(padded(text))
                    digest = hashlib.sha256(media).hexdigest()
                    if shard is None or shard.size > SHARD_BYTES:
                        if shard:
                            shard.close()
                        shard = Shard(folder)
                    out.append((len(text), digest, shard.name, *shard.add(digest, media)))
                n, digest, name, offset, length = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n, pa.int64()), pa.array(digest), pa.array(name), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    kept = docs.select(id_col, text_col)
    return by_small_batches(kept).mapInArrow(run, f"doc_id {kept.schema[id_col].dataType.simpleString()}, n_bytes long, digest string, shard string, offset long, length long")


def catalogue(stored: DataFrame) -> DataFrame:
    """One place for each digest: (digest, shard, offset, length)."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return stored.groupBy("digest").agg(place).select("digest", "place.*")


PLACE = "digest string, shard string, offset long, length long"


def _read(places: DataFrame, folder: str, look, schema: str) -> DataFrame:  # noqa: ANN001
    """The places with what look(file, offset, length) returns; a task reads neighbours in a shard, in their order."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, name, file = None, None, None
        for batch in batches:
            out = []
            for shard, offset, length in zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "length")], strict=True):
                if shard != name:
                    root = root or file_system(folder)
                    name, file = shard, root[0].open_input_file(f"{root[1]}/{shard}")
                out.append(look(file, offset, length))
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, zip(*out, strict=True))], [*batch.schema.names, *names])

    rows = places.select("digest", "shard", "offset", "length")
    return rows.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(run, f"{PLACE}, {schema}")


def headers(places: DataFrame, folder: str) -> DataFrame:
    """The places with metadata columns, by range reads of the headers alone."""
    return _read(places, folder, lambda f, offset, _: png_header(f.read_at(HEADER, offset)), "width long, height long, bits long")


def features(places: DataFrame, folder: str) -> DataFrame:
    """The places with metadata columns from the header, and with what needs the samples, from the stored bytes.

    The feature is the image's size, the mean of its samples, and the share of each 32-wide range of values in permille.
    """

    def look(file, offset: int, length: int) -> tuple:  # noqa: ANN001
        width, height, bits = png_header(file.read_at(HEADER, offset))
        media = file.read_at(length, offset)
        payload = from_png(media)
        samples = np.frombuffer(payload, np.uint8)
        shares = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
        feature = f"{width}x{height};mean={int(samples.sum(dtype=np.int64)) // len(samples)};" + ",".join(map(str, shares.tolist()))
        return width, height, bits, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature

    return _read(places, folder, look, "width long, height long, bits long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every payload, then reads headers and payloads back: one row per row of docs with all columns."""
    folder = new_path(docs.sparkSession, "media")
    stored = written(store(docs, folder, id_col, text_col), "media-rows")
    hot = stored.groupBy("digest").count().where(F.col("count") * HUBS > stored.count()).select("digest", F.lit(SALTS).alias("salts"))  # at most HUBS rows
    salts = F.coalesce("salts", F.lit(1))
    rows = stored.select("doc_id", "n_bytes", "digest").join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    read = features(catalogue(stored), folder).join(F.broadcast(hot), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return rows.drop("salts").join(read.drop("salts"), ["digest", "salt"]).drop("salt")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns: list[str | Column] = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height"]
    return media_columns(docs).select(*columns)
