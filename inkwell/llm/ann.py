"""Approximate nearest neighbours: an inverted file of coarse cells with product-quantised residuals.

Coarse centroids and code books are fitted by k-means on a bounded sample (`sample_rows` vectors, by the hash of the
id); how many cells a query probes is read off the sample as well: enough to cover `COVERED` of its own nearest
neighbours, a few for clustered vectors and more than half for shapeless ones. Every distinct vector is put into the cell of its nearest centroid, and its residual is coded by the nearest entry
of each sub-space's code book. A query probes its nearest cells: tables of distances from the query's residual to the
code book entries give each member's approximate distance by look-ups, the best `rerank` candidates are joined to the
original vectors, and their distances are computed exactly.

No cell's share of those candidates is cut: a cell hands on all members within a bound, the distance of the sample's
`rerank`-th member, and `rerank` of them if there are more.

Equal vectors are one entry of the index that stands for all their ids, so a vector that fills a third of the table
costs one row; as only the k nearest are asked for, its k+1 smallest ids answer for the rest, exactly. Cells are cut
into blocks and a cell's queries into groups by counted sizes, so that no task gets more than about `block_rows`
members and `group_rows` queries of one cell.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most
take no part, neither as queries nor as candidates; equal distances are ordered by vec_id; with fewer than k
candidates all are returned; repeated ids are repeated candidates of one id, of which the nearest counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import written

K, RERANK = 10, 500
#: Cells are probed until so many of the sample's own nearest neighbours are covered.
COVERED, TRIED = 0.97, 256
SAMPLE_ROWS, MOST_CELLS = 20_000, 4096
SUB_DIMS, CODES = 4, 256
BLOCK_ROWS, GROUP_ROWS = 8192, 1024


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>, same: digest of the vector) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    big = F.lit(float("inf"))
    fits = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)
    # adding 0.0 makes the two zeros equal
    return vectors.where(fits & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")).withColumn("same", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, centers, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        cuts = np.searchsorted(near[order], np.arange(k))
        full = np.flatnonzero(np.diff(np.r_[cuts, len(x)]))
        centers[full] = np.add.reduceat(x[order], cuts[full], axis=0) / np.diff(np.r_[cuts, len(x)])[full, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    half = (centers**2).sum(1) / 2
    for a in range(0, len(x), 4096):
        d = half - x[a : a + 4096] @ centers.T
        if n == 1:
            out[a : a + 4096, 0] = d.argmin(1)
        else:
            some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centers) else np.tile(np.arange(len(centers)), (len(d), 1))
            out[a : a + 4096] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return out


class Index:
    """Coarse centroids and code books; a fixed size, whatever the table."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dims = sample.shape[1]
        self.parts = math.ceil(self.dims / SUB_DIMS)
        x = sample.astype(np.float64)
        self.cells = k_means(x, max(1, min(MOST_CELLS, len(x) // 8, round(math.sqrt(rows)))), 8, rng)
        left = self.split(x - self.cells[nearest(x, self.cells, 1)[:, 0]])
        self.probes = self.enough_probes(x[rng.permutation(len(x))[:TRIED]], x)
        self.books = np.stack([k_means(left[:, p], min(CODES, len(x)), 6, rng) for p in range(self.parts)])
        cell, codes = self.assign(x)
        order = np.argsort(cell, kind="stable")
        self.known, self.cuts = codes[order], np.searchsorted(cell[order], np.arange(len(self.cells) + 1))

    def enough_probes(self, tried: np.ndarray, x: np.ndarray) -> int:
        order = nearest(tried, self.cells, len(self.cells))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
        near = nearest(tried, x, min(K + 1, len(x)))[:, 1:]  # the first is the vector itself
        if not near.size:
            return len(self.cells)
        return int(np.quantile(np.take_along_axis(place, nearest(x, self.cells, 1)[:, 0][near], 1), COVERED)) + 1

    def split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * SUB_DIMS))
        padded[:, : self.dims] = x
        return padded.reshape(len(x), self.parts, SUB_DIMS)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of each vector."""
        cell = nearest(x, self.cells, 1)[:, 0]
        left = self.split(x - self.cells[cell])
        return cell, np.stack([nearest(left[:, p], self.books[p], 1)[:, 0] for p in range(self.parts)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances from each query's residual to every code book entry: (query, part, code)."""
        left = self.split(queries - self.cells[cell])
        return ((left[:, :, None, :] - self.books[None]) ** 2).sum(3)

    def bound(self, queries: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
        """For each query a distance that n members of its cells do not pass: that of the sample's n-th, as the sample is of members."""
        out, parts = np.full(len(queries), np.inf), np.arange(self.parts)
        for a in range(0, len(queries) if n <= len(self.known) else 0, 64):
            near = np.full((len(queries[a : a + 64]), len(self.known)), np.inf)
            flat = cells[a : a + 64].ravel()
            order = np.argsort(flat, kind="stable")
            names, starts = np.unique(flat[order], return_index=True)
            for cell, at in zip(names, np.split(order // cells.shape[1], starts[1:]), strict=True):
                own = slice(self.cuts[cell], self.cuts[cell + 1])
                if own.start < own.stop:
                    for q, table in zip(at, self.tables(queries[a : a + 64][at], cell), strict=True):
                        near[q, own] = table[parts, self.known[own]].sum(1)
            out[a : a + 64] = np.partition(near, n - 1, axis=1)[:, n - 1]
        return out * (1 + 1e-9)


def fit(distinct: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    rows, dims = distinct.count(), distinct.select(F.size("v")).first()
    if not rows:
        return None
    share = min(1.0, 1.2 * sample_rows / rows)
    some = distinct.where(F.pmod(F.xxhash64("same"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy("same").limit(sample_rows).select("v").collect()
    return Index(np.array([r[0] for r in some] or [distinct.select("v").first()[0]]).reshape(-1, dims[0]), rows)


def indexed(distinct: DataFrame, index: Index) -> DataFrame:
    """(same, cell, codes) of every distinct vector."""
    shared = distinct.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                cell, codes = shared.value.assign(x)
                yield pa.RecordBatch.from_arrays([b.column("same"), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary())], ["same", "cell", "codes"])

    return distinct.select("same", "v").mapInArrow(run, "same string, cell long, codes binary")


def probed(queries: DataFrame, index: Index, probes: int, rerank: int) -> DataFrame:
    """(query, v, cell, bound) for the cells that each distinct query looks into; none of its `rerank` best is beyond the bound."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                n = min(probes, len(shared.value.cells))
                cells = nearest(x, shared.value.cells, n)
                at = pa.array(np.repeat(np.arange(b.num_rows), n))
                yield pa.RecordBatch.from_arrays([b.column("same").take(at), b.column("v").take(at), pa.array(cells.ravel()), pa.array(shared.value.bound(x, cells, rerank)).take(at)], ["query", "v", "cell", "bound"])

    return queries.select("same", "v").mapInArrow(run, "query string, v array<double>, cell long, bound double")


def dealt(rows: DataFrame, counts: DataFrame, own: Column, other: str, of: str) -> DataFrame:
    """Rows of a cell dealt to its parts, and repeated for every part of the other side."""
    every = F.explode(F.sequence(F.lit(0), F.col("parts_" + other) - 1)).alias(other)
    return rows.join(counts, "cell").select(*rows.columns, own.alias(of), every)


def candidates(members: DataFrame, looks: DataFrame, index: Index, rerank: int, block_rows: int, group_rows: int) -> DataFrame:
    """(query, same): for each query its `rerank` best members by approximate distance; a block of a cell hands on as many within the query's bound, so none of them is lost."""
    shared = members.sparkSession.sparkContext.broadcast(index)
    blocks = members.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts_block"))
    groups = looks.groupBy("cell").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts_group"))
    counts = written(blocks.join(groups, "cell"), "ann-cells")  # one row a cell, at most MOST_CELLS
    left = dealt(members, counts, F.pmod(F.xxhash64("same"), F.col("parts_block")).cast("int"), "group", "block")
    right = dealt(looks, counts, F.pmod(F.xxhash64("query"), F.col("parts_group")).cast("int"), "block", "group")

    def search(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query": [], "same": [], "near": []})
        codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1).astype(np.int64)
        same, found, near, of = own["same"].to_numpy(), [], [], []
        parts = np.arange(codes.shape[1])
        for a in range(0, len(asked), 64):
            some = asked.iloc[a : a + 64]
            for q, bound, table in zip(some["query"], some["bound"], shared.value.tables(np.stack(some["v"]), int(key[0])), strict=True):
                d = table[parts, codes].sum(1)
                best = np.flatnonzero(d <= bound)
                best = best[np.argpartition(d[best], rerank - 1)[:rerank]] if rerank < len(best) else best
                found.append(same[best])
                near.append(d[best])
                of.append((q, len(best)))
        names, times = zip(*of, strict=True)
        return pd.DataFrame({"query": np.repeat(np.array(names, object), times), "same": np.concatenate(found), "near": np.concatenate(near)})

    keys = ["cell", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query string, same string, near double")
    best = Window.partitionBy("query").orderBy("near", "same")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rerank).select("query", "same")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query; is_query is a condition on vec_id."""
    result = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    good = written(usable(vectors, id_col, vec_col), "ann-vectors")
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], result)
    good = good.where(F.size("v") == size["n"])
    first = F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))
    ids = written(good.select("same", "vec_id").distinct().withColumn("place", first).where(F.col("place") <= k + 1), "ann-ids")
    distinct = written(good.groupBy("same").agg(F.first("v").alias("v")), "ann-distinct")
    index = fit(distinct, sample_rows)
    members = written(indexed(distinct, index), "ann-index")
    asked = good.where(is_query).select("vec_id", "same").distinct()
    queries = distinct.join(asked.select("same").distinct(), "same", "left_semi")
    near = candidates(members, probed(queries, index, probes or index.probes, rerank), index, rerank, block_rows, group_rows)
    pairs = near.join(distinct.select("same", F.col("v").alias("b")), "same").join(distinct.select(F.col("same").alias("query"), F.col("v").alias("a")), "query")
    exact = pairs.select("query", "same", distance(F.col("a"), F.col("b")).alias("score"))
    expanded = exact.join(ids.select("same", "vec_id"), "same")
    closest = Window.partitionBy("query").orderBy("score", "vec_id")
    top = expanded.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= k + 1).select("query", "vec_id", "score")
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("same").alias("query")).join(top, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
