"""Small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master, which has no other machines, gets a local one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = spark.conf.get("inkwell.shared.dir", None)
        if not conf:
            conf = "file://" + tempfile.mkdtemp(prefix="spark-inkwell-")
            spark.conf.set("inkwell.shared.dir", conf)
    return conf


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a later loss of executors costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(name: str, taken: Iterable[str]) -> str:
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


#: Rows of documents are long: Arrow batches of so many keep the memory of executors and Python workers small.
BATCH_ROWS = 1_000


def by_small_batches(docs: DataFrame) -> DataFrame:
    """The same frame; from now on its session hands rows to Python in batches of BATCH_ROWS at most."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return docs


_KEPT: list[tuple] = []


def kept(name: str, key: object = None, make: Callable[[], object] = lambda: None):  # noqa: ANN201
    """What a worker process keeps from task to task: one operator's model or cache at a time.

    Workers outlive stages; whatever the stage before has kept is released when another operator asks for its own.
    """
    if not _KEPT or _KEPT[0][:2] != (name, key):
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT.append((name, key, make()))
    return _KEPT[0][2]


def slices(batch: pa.RecordBatch, text_col: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text (or one row), so that a task's memory has a bound."""
    if not batch.num_rows:
        return
    at, total = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(text_col)).to_pylist()):
        if total and total + (n or 0) > size:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n or 0
    yield batch.slice(at)


def judged(docs: DataFrame, judge: Callable[[list], Iterable[tuple]], fields: list[tuple[str, T.DataType]], id_col: str, text_col: str, keep: bool, size: int = 4_000_000) -> DataFrame:
    """(doc_id, the judge's fields) of every row, and with `keep` all given columns in a struct `kept`, safe from clashes.

    The judge is given the texts of a part of a batch and returns a tuple of values for each.
    """
    rest = [F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("rest")] if keep else []
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *rest)
    names = [n for n, _ in fields]
    passed = ["text", "rest"] if keep else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", size):
                values = list(zip(*judge(part.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, values), *[part.column(c) for c in passed]], ["doc_id", *names, *passed])

    schema = T.StructType([slim.schema["doc_id"], *[T.StructField(n, t) for n, t in fields], *[slim.schema[c] for c in passed]])
    out = by_small_batches(slim).mapInArrow(run, schema)
    if not keep:
        return out
    whole = F.struct(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])
    return out.select("doc_id", *names, whole.alias("kept"))


#: Classes of a model, and rows a class that a sample reads over twice its size, so that chance never makes it short.
MOST_GROUPS, MARGIN_ROWS = 1_000, 50


def spread_sample(rows: DataFrame, group_col: str, id_col: str, salt: str, most: int) -> DataFrame:
    """At most `most` rows a group, those of least hash of the id: (chosen, of_group, place), for a broadcast join.

    Groups are counted first; then a filter by the hash, on the rows where they lie, leaves about twice as many of a
    large group (and MARGIN_ROWS), and only their ids reach the driver, which orders them. No group is sent to a task,
    and the driver holds at most groups * (2 * most + MARGIN_ROWS) ids. Groups are the classes of a model: it learns the
    MOST_GROUPS with most rows (of equal ones those that sort first). Rows are to be distinct by (id, group).
    """
    hashed = rows.select(F.col(id_col).alias("chosen"), F.col(group_col).alias("of_group"), F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)).alias("h"))
    sizes = hashed.groupBy("of_group").count().orderBy(F.desc("count"), "of_group").limit(MOST_GROUPS).collect()
    shares = [(r["of_group"], int(1_000_000 * (2 * most + MARGIN_ROWS) / r["count"]) + 1) for r in sizes]
    share_schema = T.StructType([T.StructField("group", hashed.schema["of_group"].dataType), T.StructField("share", T.LongType())])
    schema = T.StructType([*hashed.select("chosen", "of_group").schema.fields, T.StructField("place", T.IntegerType())])
    known = F.broadcast(rows.sparkSession.createDataFrame(shares, share_schema))  # at most MOST_GROUPS rows
    thinned = hashed.join(known, (F.col("of_group") == F.col("group")) & (F.pmod("h", F.lit(1_000_000)) < F.col("share"))).drop("group", "share")
    places: dict = {}
    for r in sorted(thinned.collect(), key=lambda r: (r["h"], r["chosen"])):
        places.setdefault(r["of_group"], []).append(r["chosen"])
    return rows.sparkSession.createDataFrame([(chosen, group, i + 1) for group, found in places.items() for i, chosen in enumerate(found[:most])], schema)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by
