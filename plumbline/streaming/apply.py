"""The command log as a stream: apply with last-write-wins, and request-id deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.log import latest


class TableApplier:
    """foreachBatch target that keeps the last command of every id in versioned Parquet folders under ``path``.

    A micro-batch is merged into the version before it and written beside it; the pointer file is written last, so a
    failed batch leaves the old version in place, and a batch that runs again (same id) overwrites only its own folder.
    """

    def __init__(self, path: str):
        self.path = path

    def _pointer(self, spark):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target

    def version(self, spark) -> int | None:
        files, target = self._pointer(spark)
        if not files.exists(target):
            return None
        stream = files.open(target)
        try:
            return stream.readLong()
        finally:
            stream.close()

    def read(self, spark) -> DataFrame | None:
        v = self.version(spark)
        return None if v is None else spark.read.parquet(f"{self.path}/v={v}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        v = self.version(spark)
        if v is not None and v >= batch_id:
            return
        new = latest(batch)
        old = self.read(spark)
        merged = new if old is None else latest(old.unionByName(new))
        merged.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        files, target = self._pointer(spark)
        stream = files.create(target, True)
        stream.writeLong(batch_id)
        stream.close()


def dedup_stream(commands: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """First command of each request id; with ``ttl_ms`` ids are forgotten that long after they were seen. Rows of one id stay in order of log_index."""
    schema = commands.schema

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("log_index")
        if key[0] == "":
            yield rows
        elif not state.exists:
            state.update((int(rows.iloc[0]["log_index"]),))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
            yield rows.head(1)

    return commands.groupBy("request_id").applyInPandasWithState(first, schema, "log_index long", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


def commands_from_events(events: DataFrame) -> DataFrame:
    """Events as commands: errors delete a user, all else upserts its value."""
    return events.select(
        F.col("event_id").alias("log_index"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("cmd"),
        F.col("value"), F.concat_ws("-", F.col("user_id").cast("string"), F.col("props")).alias("request_id"),
    )
