"""Binary log segments and collection snapshots.

A segment is a sequence of records: magic, payload length and CRC-32 of the payload as little-endian u32, then the
payload. Reading stops at the first record that is short, has another magic, or fails its checksum.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Record magic, "RDB1" read as little-endian. Fixed value.
MAGIC = 0x31424452
_HEAD = struct.Struct("<III")


def encode_records(payloads: list[bytes]) -> bytes:
    return b"".join(_HEAD.pack(MAGIC, len(p), zlib.crc32(p)) + p for p in payloads)


def decode_records(data: bytes) -> tuple[list[bytes], int]:
    """Payloads of the valid prefix, and its length in bytes."""
    out, at = [], 0
    while at + _HEAD.size <= len(data):
        magic, size, crc = _HEAD.unpack_from(data, at)
        payload = data[at + _HEAD.size : at + _HEAD.size + size]
        if magic != MAGIC or len(payload) < size or zlib.crc32(payload) != crc:
            break
        out.append(payload)
        at += _HEAD.size + size
    return out, at


def assign_segments(log: DataFrame, max_bytes: int, payload: str = "payload") -> DataFrame:
    """Adds segment: a new one begins before the record that would take the current one past ``max_bytes``; a larger record has one of its own.

    Where a segment begins depends on the one before, so one task passes over indexes and sizes, ordered; payloads stay where they are and meet
    the segments' first indexes in a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, segment = 0, -1
        for batch in batches:
            out = []
            for index, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment < 0 or (used and used + size > max_bytes):
                    segment, used = segment + 1, 0
                used += size
                out.append(segment)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["i", "segment"])

    size = (F.octet_length(F.col(payload)) + F.lit(_HEAD.size)).cast("long").alias("size")
    placed = log.select("log_index", size).orderBy("log_index").coalesce(1).mapInArrow(run, "i long, segment long")
    return log.join(placed, F.col("log_index") == F.col("i")).select(*log.columns, "segment")


def pack_segments(log: DataFrame) -> DataFrame:
    """segment, start, data: one binary row per segment (bounded by the segment size)."""

    def pack(table: pa.Table) -> pa.Table:
        t = table.sort_by("log_index")
        data = encode_records([x.as_py() for x in t["payload"]])
        return pa.table({"segment": [t["segment"][0].as_py()], "start": [t["log_index"][0].as_py()], "data": pa.array([data], pa.binary())})

    return log.select("segment", "log_index", "payload").groupBy("segment").applyInArrow(pack, "segment long, start long, data binary")


def unpack_segments(segments: DataFrame) -> DataFrame:
    """log_index, payload of the valid prefix: later segments are dropped after the first that is damaged."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payloads, good = decode_records(data)
                n = len(payloads)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * (n + 1), pa.int64()), pa.array([*range(start, start + n), None], pa.int64()), pa.array([*payloads, None], pa.binary()), pa.array([None] * n + [good == len(data)], pa.bool_())],
                    ["segment", "log_index", "payload", "whole"],
                )

    rows = segments.select("segment", "start", "data").mapInArrow(unpack, "segment long, log_index long, payload binary, whole boolean")
    bad = rows.filter(~F.col("whole")).agg(F.min("segment").alias("bad"))
    keep = rows.filter(F.col("log_index").isNotNull()).crossJoin(F.broadcast(bad)).filter(F.col("bad").isNull() | (F.col("segment") <= F.col("bad")))
    return keep.select("log_index", "payload")


def save_snapshot(collection: DataFrame, path: str, *, index: int, term: int, metric: str, data_type: str) -> None:
    """Vectors and metadata go to a folder beside it, which then takes the snapshot's name: readers see the old one or the new one whole."""
    spark = collection.sparkSession
    dim = collection.agg(F.max(F.size("vec"))).first()[0] or 0
    meta = {"raft_term": term, "raft_index": index, "dim": dim, "metric": metric, "data_type": data_type, "created_at": int(time.time())}
    fresh, old, place = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f"_tmp-{index}-{uuid.uuid4().hex}", f"_old-{index}-{uuid.uuid4().hex}", f"snap={index}"))
    collection.write.parquet(f"{fresh}/vectors")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{fresh}/meta")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    replaced = files.exists(place) and files.rename(place, old)
    if not files.rename(fresh, place):
        raise OSError(f"could not rename {fresh} to {place}")
    if replaced:
        files.delete(old, True)


def load_snapshot(spark: SparkSession, path: str, index: int, *, dim: int, metric: str, data_type: str) -> tuple[DataFrame, dict]:
    """Vectors and metadata; ValueError where dimension, metric or type differ."""
    meta = json.loads(spark.read.text(f"{path}/snap={index}/meta").first()[0])
    for name, want in (("dim", dim), ("metric", metric), ("data_type", data_type)):
        if meta[name] != want:
            raise ValueError(f"snapshot has {name} {meta[name]}, expected {want}")
    return spark.read.parquet(f"{path}/snap={index}/vectors"), meta


def write_latency_csv(rows: DataFrame, path: str) -> None:
    """timestamp_us, latency_us, success, mode sorted by timestamp, with a header."""
    rows.select("timestamp_us", "latency_us", "success", "mode").orderBy("timestamp_us").write.mode("overwrite").csv(path, header=True)


def write_counters_csv(rows: DataFrame, path: str) -> None:
    rows.select("metric", "count", "mean_us", "max_us").orderBy("metric").write.mode("overwrite").csv(path, header=True)
