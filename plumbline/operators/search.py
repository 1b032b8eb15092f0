"""Exact and filtered nearest-neighbour search over a collection (id, vec).

Two physical plans behind one function. The expression plan is plain Catalyst: queries are joined to the collection,
the distance is a Column, and a window keeps the k nearest (Catalyst puts a group limit before its shuffle). The matrix
plan broadcasts a block of queries whose size has been checked, multiplies it with each Arrow batch of the
collection in tiles of bounded size, keeps the k nearest of every partition, and ranks those; more queries mean more blocks.
Ties are broken by id. k of 0 gives no rows, k above the collection's size gives all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import metrics

DIGITS = 6
#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Queries and members whose distances are in memory at once: 8 MB of a task.
TILE_QUERIES, TILE_MEMBERS = 256, 4096


def rounded(d: Column, digits: int = DIGITS) -> Column:
    """Rounded, with -0.0 made 0.0, so that equal distances are equal everywhere."""
    return F.round(d, digits) + F.lit(0.0)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """qid, id, distance -> the k nearest of each query, with rank."""
    order = W.partitionBy("qid").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame, k: int = 0) -> list[DataFrame]:
    """The queries in parts of about ``BLOCK_BYTES`` of vectors and k hits each, by their counted size: what may be broadcast at once, and kept by a task."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    blocks = max(1, -(-(size.n * (max(1, size.d or 1) * 8 + k * 16)) // BLOCK_BYTES))
    return [queries] if blocks == 1 else [queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) for b in range(blocks)]


def pairwise(collection: DataFrame, queries: DataFrame, metric="ip", kind: str = "f32") -> DataFrame:
    """Distances of all (query, member) pairs of a stated query set, block by block: qid, id, distance."""
    parts = [collection.crossJoin(F.broadcast(part.select(F.col("id").alias("qid"), F.col("vec").alias("q")))) for part in query_blocks(queries)]
    return reduce(DataFrame.union, parts).select("qid", "id", rounded(metrics.distance(metric, F.col("vec"), F.col("q"), kind)).alias("distance"))


class _Nearest:
    """The k nearest members of some queries, kept while batches of members pass."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.d, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.bound = np.full(n, np.inf)  # of the k-th distance, once there are k

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        bound = self.bound
        if d.shape[1] > self.k and not np.isfinite(bound).all():
            bound = np.fmin(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        # Every entry that may round to the k-th distance stays a candidate until ids decide; NaN comes last.
        row, at = np.nonzero(~(d > (bound + 10.0**-DIGITS + np.abs(np.where(np.isfinite(bound), bound, 0)) * 1e-12)[:, None]))
        if not len(row):
            return
        row, d, i = np.append(self.row, row), np.append(self.d, np.round(d[row, at], DIGITS) + 0.0), np.append(self.i, ids[at])
        order = np.lexsort((i, d, row))
        row = row[order]
        start = np.searchsorted(row, np.arange(self.n))
        keep = np.arange(len(row)) - start[row] < self.k
        order = order[keep]
        self.row, self.d, self.i = row[keep], d[order], i[order]
        end = np.searchsorted(self.row, np.arange(self.n), side="right")
        full = np.flatnonzero(end - np.searchsorted(self.row, np.arange(self.n)) == self.k)
        last = self.d[end[full] - 1]
        self.bound[full] = np.where(np.isnan(last), np.inf, last)


def _matrix_hits(collection: DataFrame, queries: DataFrame, k: int, metric, kind: str) -> DataFrame:
    spark = collection.sparkSession
    id_kind = collection.schema["id"].dataType.simpleString()
    q_kind = queries.schema["id"].dataType.simpleString()
    out = None
    for part in query_blocks(queries, k):
        rows = part.select("id", F.col("vec").cast("array<double>").alias("vec")).toArrow()
        ids, matrix = rows["id"].combine_chunks(), _stack(rows["vec"].combine_chunks())
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            tiles = [(at, _Nearest(len(q[at : at + TILE_QUERIES]), k)) for at in range(0, len(q), TILE_QUERIES)]
            kind_of_id = None
            for whole in batches:
                kind_of_id = whole.schema.field(0).type
                for begin in range(0, whole.num_rows, TILE_MEMBERS):
                    batch = whole.slice(begin, TILE_MEMBERS)
                    x, ids = _stack(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
                    for at, nearest in tiles:
                        nearest.add(metrics.matrix(metric, q[at : at + TILE_QUERIES], x, kind), ids)
            for at, nearest in tiles:
                for begin in range(0, len(nearest.row), 1 << 16):
                    some = slice(begin, begin + (1 << 16))
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(at + nearest.row[some])), pa.array(nearest.i[some], kind_of_id), pa.array(nearest.d[some])], ["qid", "id", "distance"])

        hits = collection.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"qid {q_kind}, id {id_kind}, distance double")
        out = hits if out is None else out.union(hits)
    return out


def _stack(vectors: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    n = len(vectors)
    if not n:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % n:
        raise ValueError("vectors of different dimensions")
    return flat.reshape(n, -1)


def search(collection: DataFrame, queries: DataFrame, k: int, metric="ip", *, predicate: Column | None = None, kind: str = "f32", plan: str = "matrix") -> DataFrame:
    """qid, id, distance, rank of the k nearest members of every query; ``predicate`` is applied before ranking."""
    if predicate is not None:
        collection = collection.filter(predicate)
    collection = collection.select("id", "vec")
    if k <= 0:
        return rank_hits(pairwise(collection, queries, metric, kind), 0)
    hits = _matrix_hits(collection, queries, k, metric, kind) if plan == "matrix" else pairwise(collection, queries, metric, kind)
    return rank_hits(hits, k)


def search_one(collection: DataFrame, vector: list[float], k: int, metric="ip") -> DataFrame:
    """id, distance of the k nearest to one literal vector, nearest first (a bounded top-k without a shuffle)."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return collection.select("id", rounded(metrics.distance(metric, F.col("vec"), q)).alias("distance")).orderBy("distance", "id").limit(k)


def within(collection: DataFrame, queries: DataFrame, radius: float, metric="ip") -> DataFrame:
    """All pairs of a stated query set at a distance of at most ``radius``."""
    return pairwise(collection, queries, metric).filter(F.col("distance") <= radius)


def merge_hits(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Top k of two result sets; at equal distances the incoming row goes first."""
    both = old.select("qid", "id", "distance", F.lit(1).alias("age")).unionByName(new.select("qid", "id", "distance", F.lit(0).alias("age")))
    order = W.partitionBy("qid").orderBy("distance", "age", "id")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).drop("age")


def padded(hits: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """Exactly ``width`` rows per query: missing hits have id 0 and distance NaN."""
    slots = queries.select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(width).cast("long"))).alias("rank"))
    return slots.join(hits, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.coalesce("distance", F.lit(float("nan"))).alias("distance"))


def collected(hits: DataFrame) -> DataFrame:
    """qid, hits: the sorted hits of each query as one array (front, back and membership are array functions on it)."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))), lambda h: F.struct(h["id"].alias("id"), h["distance"].alias("distance")))
    return hits.groupBy("qid").agg(sorted_.alias("hits"))


def search_stats(collection: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, visited_members, computed_distances, count of an exact search."""
    n = collection.agg(F.count(F.lit(1)).alias("n"))
    return queries.select(F.col("id").alias("qid")).crossJoin(n).select("qid", F.col("n").alias("visited_members"), F.col("n").alias("computed_distances"), F.least(F.col("n"), F.lit(k)).cast("long").alias("count"))


def diverse(hits: DataFrame, collection: DataFrame, k: int, metric="ip") -> DataFrame:
    """Diverse top-k: a candidate stays only if no kept one is closer to it than the query is. hits: qid, id, distance, rank."""
    rows = hits.join(collection.select("id", F.col("vec").cast("array<double>").alias("vec")), "id")

    def pick(pdf):
        pdf = pdf.sort_values("rank")
        x = np.stack(pdf["vec"].to_numpy()) if len(pdf) else np.zeros((0, 0))
        between, kept = metrics.matrix(metric, x, x), []
        for i, d in enumerate(pdf["distance"].to_numpy()):
            if len(kept) < k and all(between[i, j] >= d for j in kept):
                kept.append(i)
        return pdf.iloc[kept][["qid", "id", "distance"]]

    return rows.groupBy("qid").applyInPandas(pick, "qid long, id long, distance double")
