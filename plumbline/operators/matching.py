"""One-to-one similarity matching by deferred acceptance, in rounds of DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import search


def knn_join(left: DataFrame, right: DataFrame, k: int, metric="ip", plan: str = "matrix") -> DataFrame:
    """l, r, distance, rank: the k nearest right members of every left member."""
    hits = search.search(right, left, k, metric, plan=plan)
    return hits.select(F.col("qid").alias("l"), F.col("id").alias("r"), "distance", "rank")


def default_proposals(n: int, threads: int = 1) -> int:
    return max(1, int(math.log(max(1, n))) + threads)


def stable_match(candidates: DataFrame) -> DataFrame:
    """l, r, distance of the proposer-optimal stable matching. candidates: l, r, distance, rank (1 is the nearest).

    Every proposer holds one place in its list. A round lets each candidate keep its nearest proposer and moves all
    others one place on; proposers whose list has ended are out. Rounds end when nobody has moved.
    """
    place = cut_lineage(candidates.select("l").distinct().withColumn("at", F.lit(1).cast("long")))
    while True:
        asked = place.join(candidates, (place["l"] == candidates["l"]) & (place["at"] == candidates["rank"])).select(place["l"], "at", "r", "distance")
        held = asked.groupBy("r").agg(F.min(F.struct("distance", "l")).alias("best"))
        out = asked.join(held.withColumnRenamed("r", "r2"), F.col("r") == F.col("r2")).select("l", "at", "r", "distance", (F.col("best.l") == F.col("l")).alias("kept"))
        step = cut_lineage(out)
        if step.filter(~F.col("kept")).isEmpty():
            return step.select("l", "r", "distance")
        place = step.select("l", F.when(F.col("kept"), F.col("at")).otherwise(F.col("at") + 1).alias("at"))


def whole_match(left: DataFrame, right: DataFrame, metric="ip", width: int = 16) -> DataFrame:
    """l, r, distance of the stable matching over all pairs, with lists of ``width`` at a time; the metric is symmetric.

    Both sides rank pairs by distance, then id, so two members that are each other's nearest free ones belong together. A phase lists the
    nearest free members of each free member; rounds match mutual nearest ones along the lists until none are left, then lists are made
    anew for those still free. A member whose list has run out waits for the next phase. The pairs of all members are never kept.
    """
    tasks = left.sparkSession.sparkContext.defaultParallelism
    empty = left.sparkSession.createDataFrame([], left.select(F.col("id").alias("l"), F.col("id").alias("r"), F.lit(0.0).alias("distance")).schema)
    done, n = empty, 0
    while True:
        a, b = (x.select("id", "vec").join(done.select(F.col(side).alias("id")), "id", "left_anti") for x, side in ((left, "l"), (right, "r")))
        ours = cut_lineage(knn_join(a, b, width, metric).select("l", "r", "distance").coalesce(tasks))
        theirs = cut_lineage(knn_join(b, a, width, metric).select(F.col("l").alias("r"), F.col("r").alias("l"), "distance").coalesce(tasks))
        begun, before = n, -1
        while n > before:
            new = done.union(_mutual(*(x.join(done.select("l"), "l", "left_anti").join(done.select("r"), "r", "left_anti") for x in (ours, theirs))))
            done = cut_lineage(new.coalesce(tasks))
            before, n = n, done.count()
        if n == begun:  # nobody left, or distances that differ in the last digit by direction: the nearest pair belongs together
            nearest = ours.select("l", "r", "distance").orderBy("distance", "l", "r").limit(1)
            done = cut_lineage(done.union(nearest).coalesce(tasks))
            n = done.count()
            if n == begun:
                return done


def _mutual(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """l, r, distance of the pairs that are nearest in the lists of both."""
    one = ours.groupBy("l").agg(F.min(F.struct("distance", "r")).alias("x")).select("l", "x.r", "x.distance")
    two = theirs.groupBy("r").agg(F.min(F.struct("distance", "l")).alias("y")).select(F.col("r").alias("r2"), F.col("y.l").alias("l2"))
    return one.join(two, (F.col("l") == F.col("l2")) & (F.col("r") == F.col("r2"))).select("l", "r", "distance")


def match(left: DataFrame, right: DataFrame, metric="ip", proposals: int | None = None) -> DataFrame:
    """l, r, distance. The smaller side proposes; ``proposals`` caps each one's list (None: ln(n) + 1; 0: no cap)."""
    n, m = left.count(), right.count()
    swap = m < n
    a, b = (right, left) if swap else (left, right)
    if proposals == 0 and not callable(metric):
        return whole_match(left, right, metric)
    most = max(n, m) if proposals == 0 else proposals or default_proposals(min(n, m))
    out = stable_match(cut_lineage(knn_join(a, b, most, metric)))
    return out.select(F.col("r").alias("l"), F.col("l").alias("r"), "distance") if swap else out
