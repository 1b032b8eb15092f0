"""Mutations and lookups on a collection (id, vec): every call returns a new DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..types import check_id, metric_kind
from . import search


def upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (id, vec, seq) replace members of the same id; the highest seq wins."""
    new = rows.groupBy("id").agg(F.max_by("vec", "seq").alias("vec"))
    return state.join(new, "id", "left_anti").select("id", "vec").unionByName(new.select("id", "vec"))


def delete(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Missing ids are no error."""
    return state.join(ids.select("id").distinct(), "id", "left_anti")


def add(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of an insert that refuses existing ids, also those that an earlier row (by seq, if there is one) has just added."""
    order = W.partitionBy("id").orderBy("seq" if "seq" in rows.columns else "id")
    turn = rows.withColumn("turn", F.row_number().over(order))
    known = state.select("id").distinct().withColumn("known", F.lit(True))
    marked = turn.join(known, "id", "left").withColumn("ok", F.col("known").isNull() & (F.col("turn") == 1))
    return marked.filter("ok").select(*rows.columns), marked.filter(~F.col("ok")).select(*rows.columns)


def remove_count(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def rename(state: DataFrame, old: int, new: int, multi: bool = False) -> DataFrame:
    """Move all vectors of ``old`` to ``new``; nothing changes if ``new`` exists (unless multi)."""
    check_id(new)
    taken = state.agg(F.max(F.when(F.col("id") == new, 1).otherwise(0)).alias("taken"))
    moves = (F.col("id") == old) & ((F.col("taken") == 0) | F.lit(multi))
    return state.crossJoin(F.broadcast(taken)).withColumn("id", F.when(moves, F.lit(new)).otherwise(F.col("id")).cast(state.schema["id"].dataType)).drop("taken")


def get(state: DataFrame, key: int, limit: int | None = None) -> DataFrame:
    out = state.filter(F.col("id") == key)
    return out if limit is None else out.limit(limit)


def contains(state: DataFrame, keys: DataFrame) -> DataFrame:
    """id, present, count for each asked key."""
    n = state.join(keys, "id", "left_semi").groupBy("id").count()
    return keys.join(n, "id", "left").select("id", F.col("count").isNotNull().alias("present"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def export_keys(state: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the keys in id order."""
    return state.select("id").orderBy("id").offset(offset).limit(limit)


def sizes(latest: DataFrame) -> DataFrame:
    """size, deleted, total_slots from the last command of each id."""
    live = F.count_if(F.col("cmd") != "delete")
    return latest.agg(live.alias("size"), F.count_if(F.col("cmd") == "delete").alias("deleted"), F.count(F.lit(1)).alias("total_slots"))


class VectorCollection:
    """A collection with the usual verbs; arguments are checked here, results are DataFrames."""

    def __init__(self, state: DataFrame, dim: int, metric: str = "ip"):
        self.state, self.dim, self.metric = state, dim, metric_kind(metric)

    def upsert(self, key: int, vector: list[float]) -> VectorCollection:
        check_id(key)
        if len(vector) != self.dim:
            raise ValueError(f"dimension {len(vector)}, expected {self.dim}")
        row = self.state.sparkSession.createDataFrame([(key, vector, 0)], "id long, vec array<double>, seq int")
        return VectorCollection(upsert(self.state.select("id", F.col("vec").cast("array<double>").alias("vec")), row), self.dim, self.metric)

    def delete(self, key: int) -> VectorCollection:
        return VectorCollection(self.state.filter(F.col("id") != key), self.dim, self.metric)

    def search(self, vector: list[float], k: int = 10) -> DataFrame:
        if k <= 0 or len(vector) != self.dim:
            raise ValueError("k must be positive and the vector of the collection's dimension")
        return search.search_one(self.state, vector, k, self.metric)
