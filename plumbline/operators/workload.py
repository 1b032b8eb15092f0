"""Deterministic workloads: vectors that an id alone determines, and mixes of operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of ten of upserts and deletes, in this order; the rest are searches.
MIXES = {"upsert": (10, 0), "delete": (0, 10), "search": (0, 0), "mixed": (7, 0), "full": (5, 2)}
#: Multiplier and offset of the seed, shifts of the generator and its output multiplier. Fixed values.
SEED, SHIFTS, OUT = 11400714819323198485, (12, 25, 27), 2685821657736338717


def vector_for(key: Column, dim: int) -> Column:
    """The vector of a key: 16 bits of a 64-bit xorshift generator for each dimension, as parts of 65535."""

    @F.arrow_udf("array<float>")
    def make(keys: pa.Array) -> pa.Array:
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        state = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * np.uint64(SEED) + np.uint64(SEED)
        out = np.empty((len(state), dim), np.float32)
        a, b, c = map(np.uint64, SHIFTS)
        for j in range(dim):
            state = state ^ (state >> a)
            state = state ^ (state << b)
            state = state ^ (state >> c)
            out[:, j] = ((state * np.uint64(OUT)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65535)
        at = np.concatenate([[0], np.cumsum(np.where(known, dim, 0))])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out[known].ravel()), mask=None if known.all() else pa.array(~known))

    return make(key)


def operations(spark: SparkSession, n: int, mode: str) -> DataFrame:
    """i, op of n operations; of every ten, ``MIXES`` tells how many are what."""
    if mode not in MIXES:
        raise ValueError(f"no mode {mode!r}")
    upserts, deletes = MIXES[mode]
    turn = F.col("id") % 10
    op = F.when(turn < upserts, "upsert").when(turn < upserts + deletes, "delete").otherwise("search")
    return spark.range(n).select(F.col("id").alias("i"), op.alias("op"))
