"""When to compact, and compaction as a rewrite without tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratios(sizes: DataFrame) -> DataFrame:
    """size, deleted, total_slots -> the same with delete_ratio and fragmentation_ratio (0 when empty)."""
    total = F.nullif(F.col("total_slots"), F.lit(0))
    return sizes.withColumns({"delete_ratio": F.coalesce(F.col("deleted") / total, F.lit(0.0)), "fragmentation_ratio": F.coalesce((F.col("total_slots") - F.col("size")) / total, F.lit(0.0))})


def decide(state: DataFrame, delete_ratio: float = 0.2, fragmentation: float = 0.1, interval_s: int = 604_800) -> DataFrame:
    """Adds action: compact, isolate_compact, idle or skip. state: delete_ratio, fragmentation_ratio, since_s, busy."""
    action = (
        F.when(F.col("busy"), "skip")
        .when((F.col("delete_ratio") > delete_ratio) | (F.col("since_s") >= interval_s), "compact")
        .when(F.col("fragmentation_ratio") > fragmentation, "isolate_compact")
        .otherwise("idle")
    )
    return state.withColumn("action", action)


def compact(latest: DataFrame) -> DataFrame:
    """The live rows only; their deleted counter is zero by construction."""
    return latest.filter(F.col("cmd") != "delete")
