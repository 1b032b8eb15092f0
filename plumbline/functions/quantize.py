"""Storage kinds: quantisers as Column expressions, and low-precision floats as Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def _scaled(v: Column, top: int, low: int, kind: str) -> Column:
    """Unit length, times top, clamped, truncated; a zero vector gives zeros."""
    n = _norm(v)
    return F.transform(v, lambda x: F.when(n == 0, 0).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(top)), x * top / F.nullif(n, F.lit(0.0))))).cast(kind))


def quantize_i8(v: Column) -> Column:
    return _scaled(v, 127, -127, "tinyint")


def dequantize_i8(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def quantize_u8(v: Column) -> Column:
    return _scaled(v, 255, 0, "smallint")


def dequantize_u8(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 255)


def binarize(v: Column) -> Column:
    return F.transform(v, lambda x: x > 0)


def unbinarize(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x, 1.0).otherwise(0.0))


def pack_bits(bits: Column) -> Column:
    """array<boolean> to bigints of 32 bits each, the first bit the highest."""
    n = F.ceil(F.size(bits) / 32).cast("int")

    def word(i: Column) -> Column:
        part = F.slice(bits, i * 32 + 1, F.lit(32))
        value = F.aggregate(part, F.lit(0).cast("bigint"), lambda s, b: s * 2 + F.when(b, 1).otherwise(0))
        return value * F.pow(F.lit(2.0), 32 - F.size(part)).cast("bigint")

    return F.when(F.size(bits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), word))


def small_float_table(exponent: int, mantissa: int, infinity: bool) -> np.ndarray:
    """Values of the codes without sign of a float format, in code order. The highest codes are dropped where they stand for no number."""
    bias = (1 << (exponent - 1)) - 1
    codes = np.arange(1 << (exponent + mantissa))
    e, m = codes >> mantissa, (codes & ((1 << mantissa) - 1)) / (1 << mantissa)
    values = np.where(e == 0, m * 2.0 ** (1 - bias), (1 + m) * 2.0 ** (e - bias))
    return values[: len(codes) - (1 << mantissa)] if infinity else values


def _rounded(x: np.ndarray, values: np.ndarray, half_up: bool, over: float) -> np.ndarray:
    """Nearest value of the table by magnitude; ties to the even code or up; above the largest: ``over``."""
    a = np.abs(x)
    hi = np.searchsorted(values, a, side="left").clip(0, len(values) - 1)
    lo = np.maximum(hi - 1, 0)
    low, high = a - values[lo], values[hi] - a
    up = (high < low) | ((high == low) & (half_up | (hi % 2 == 0)))
    out = np.where(a >= values[-1], values[-1], np.where(up, values[hi], values[lo]))
    step = values[-1] - values[-2]
    limit = values[-1] + step / 2
    out = np.where(a >= limit if not np.isnan(over) and np.isinf(over) else np.zeros(len(a), bool), over, out)
    return np.copysign(np.where(np.isnan(x), np.nan, out), x)


def round_trip(x: np.ndarray, kind: str) -> np.ndarray:
    """float32 values as they come back from the storage kind."""
    x = np.asarray(x, np.float32)
    if kind in ("f32", "f64"):
        return x.astype(np.float64)
    with np.errstate(over="ignore"):
        if kind == "f16":
            return np.where(np.abs(x) < np.finfo(np.float32).tiny, x * 0, x).astype(np.float16).astype(np.float64)
    if kind == "bf16":
        return (x.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32).astype(np.float64)
    x = x.astype(np.float64)
    if kind == "e5m2":
        return _rounded(x, small_float_table(5, 2, True), False, np.inf)
    if kind == "e4m3":  # the all-ones code is no number; the rest of the top exponent counts
        return _rounded(x, small_float_table(4, 3, False)[:-1], False, np.nan)
    if kind == "e3m2":
        return np.where(np.abs(x) < 0.03125, 0.0, _rounded(x, small_float_table(3, 2, False), True, np.nan))
    if kind == "e2m3":
        return np.where(np.abs(x) < 0.0625, 0.0, _rounded(x, small_float_table(2, 3, False), True, np.nan))
    if kind == "i8":
        n = np.sqrt((x * x).sum())
        return np.trunc(np.clip(x * 127 / n, -127, 127)) / 127 if n else x * 0
    if kind == "u8":
        n = np.sqrt((x * x).sum())
        return np.trunc(np.clip(x * 255 / n, 0, 255)) / 255 if n else x * 0
    if kind == "b1":
        return (x > 0).astype(np.float64)
    raise ValueError(f"no storage kind {kind!r}")


def stored_as(v: Column, kind: str) -> Column:
    """The vector after a round trip through any storage kind; cast pairs are compositions of two of these."""
    round_trip(np.zeros(1), kind)

    @F.arrow_udf("array<double>")
    def through(vectors: pa.Array) -> pa.Array:
        at, flat = _flat(vectors, np.float32)
        if kind in ("i8", "u8"):  # these depend on the vector's length
            norm = np.sqrt(np.add.reduceat(np.append(flat.astype(np.float64) ** 2, 0.0), at[:-1])) if len(at) > 1 else np.zeros(0)
            norm = np.repeat(np.where(np.diff(at) > 0, norm, 0.0), np.diff(at))
            top, low = (127, -127) if kind == "i8" else (255, 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                out = np.where(norm > 0, np.trunc(np.clip(flat.astype(np.float64) * top / norm, low, top)) / top, 0.0)
        else:
            out = round_trip(flat, kind)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.float64()), mask=_nulls(vectors))

    return through(v.cast("array<float>"))


def _flat(vectors: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of all vectors as one array; null vectors are empty, null values NaN."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _nulls(values: pa.Array) -> pa.Array | None:
    return values.is_null() if values.null_count else None


def decode_vector(data: Column) -> Column:
    """Little-endian float32 bytes to array<float>; null for a length that is no multiple of four."""

    @F.arrow_udf("array<float>")
    def decode(values: pa.Array) -> pa.Array:
        values = values.cast(pa.large_binary())
        size = pc.binary_length(values).fill_null(1).to_numpy(zero_copy_only=False)
        good = size % 4 == 0
        bytes_ = values.filter(pa.array(good)).to_pylist() if not good.all() else None
        whole = b"".join(bytes_) if bytes_ is not None else values.buffers()[2]
        begin = 0 if bytes_ is not None or not len(values) else int(np.frombuffer(values.buffers()[1], np.int64)[values.offset])
        at = np.concatenate([[0], np.cumsum(np.where(good, size, 0) // 4)])
        flat = np.frombuffer(whole, "<f4", int(at[-1]), begin) if at[-1] else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.float32()), mask=None if good.all() else pa.array(~good))

    return decode(data)


def encode_vector(v: Column) -> Column:
    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        at, flat = _flat(values, np.dtype("<f4"))
        none = values.is_null().to_numpy(zero_copy_only=False)
        bits = None if not none.any() else pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(values), [bits, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])

    return encode(v)
