"""Connected components of a link table, in DataFrame operations only.

Alternating large-star and small-star steps: each replaces a node's links by links to the smallest
id around it, until every component is a star. Links never leave the executors; each round is written to the
shared folder. Minimums are pre-aggregated and their join is dealt anew, so that hot centres can be split. Links are
few beside texts, so a task goes through several partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scope, gathered, table


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = gathered(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))).withColumnRenamed("u", "w")
    return both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """edges (u, v) with v < u."""
    least = gathered(edges.groupBy("u").agg(F.min("v").alias("m"))).withColumnRenamed("u", "w")
    joined = edges.join(least, F.col("u") == F.col("w"))
    lower = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns a, b (non-null ids of one type) in; id, root out for every linked id, root the smallest of its component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    with Scope() as scope:
        edges = table(gathered(edges), "links")
        mark = _mark(edges)
        while mark[0]:
            step = _large(edges).filter(F.col("u") != F.col("v"))
            edges = table(gathered(_small(step).distinct()), "links")
            old, mark = mark, _mark(edges)
            if old == mark:
                break
        scope.keep(edges)
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    out = roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    out.scratch_path = edges.scratch_path
    return out
