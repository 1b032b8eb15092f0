"""Byte-level text primitives in numpy, shared by the Arrow-batch operators.

Texts stay in Arrow's own buffers: a batch is one uint8 array plus offsets, words are (start, end)
pairs and every hash is computed from prefix sums, so nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_R2 = 0xD6E8FEB86659FD93
_R2INV = pow(_R2, -1, 1 << 64)

#: Byte map of the plain word rule: bytes 0x20 and 0x09-0x0D separate words, A-Z become a-z.
#: A value of 0 marks a separator; a real byte 0 becomes 0xFF, which UTF-8 never holds.
SPACE_WORDS = np.arange(256, dtype=np.uint8)
SPACE_WORDS[0] = 255
SPACE_WORDS[65:91] += 32
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = 0

#: Byte map where every ASCII character that is no letter or digit separates words.
ALNUM_WORDS = SPACE_WORDS.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        ALNUM_WORDS[_b] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of a multiplier, grown on demand and kept per worker."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            size = max(n, 1 << 20)
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            while have < size:
                step = min(have, size - have)
                out[have : have + step] = out[:step] * np.uint64(pow(self.base, have, 1 << 64))
                have += step
            self.table = out
        return self.table[:n]


_POW = {True: (_Powers(_R), _Powers(_RINV)), False: (_Powers(_R2), _Powers(_R2INV))}


class SpanHash:
    """Polynomial hashes of arbitrary spans of one byte array from one prefix sum."""

    def __init__(self, data: np.ndarray, first: bool = True):
        up, self._down = _POW[first]
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        term = data.astype(np.uint64)
        term += np.uint64(1)
        term *= up.upto(len(data)) if len(data) else np.ones(0, np.uint64)
        np.cumsum(term, out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed: equal spans of equal length agree."""
        down = self._down.upto(len(self.prefix))
        return (self.prefix[end] - self.prefix[start]) * down[start]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all spans of k bytes, by start."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[:n]) * self._down.upto(n))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 array of all texts and int64 offsets; a null text has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_binary()), np.int64
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named text column holds about ``most`` bytes a piece (one row at least)."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(name))
    _, at = text_bytes(column)
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """All words of a slice of texts: ``start``, ``end`` (byte positions), ``doc`` (row of each word)."""

    def __init__(self, column: pa.Array, table: np.ndarray = SPACE_WORDS):
        raw, self.offsets = text_bytes(column)
        self.data = table[raw]
        n = len(self.data)
        inside = np.zeros(n + 2, np.bool_)
        inside[1:-1] = self.data != 0
        edge = inside[1:] != inside[:-1]  # at i: a word starts or ends before byte i
        starts = np.flatnonzero(edge & inside[1:])
        ends = np.flatnonzero(edge & inside[:-1])
        cut = np.unique(self.offsets[1:-1])
        cut = cut[(cut > 0) & (cut < n)]
        cut = cut[inside[cut] & inside[cut + 1]]  # a word never crosses two texts
        if len(cut):
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
        self.start, self.end = starts, ends
        self.rows = len(self.offsets) - 1
        #: index of the first word of each row, and one past the last at the end
        self.first = np.searchsorted(starts, self.offsets, side="left")
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    def hashes(self) -> np.ndarray:
        return SpanHash(self.data).spans(self.start, self.end)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as 64-bit hashes, sorted within the row, with row offsets.

    A row of fewer than k words has its whole sequence as one shingle, a row without words none.
    """
    h = words.hashes()
    n = len(h)
    powers = [np.uint64(pow(0x9FB21C651E98DF25, j, 1 << 64)) for j in range(k)]
    roll = np.zeros(max(0, n - k + 1), np.uint64)
    for j, p in enumerate(powers):
        roll += h[j : n - k + 1 + j] * p if n >= k else 0
    roll = mix(roll)
    out, sizes = [], np.zeros(words.rows, np.int64)
    first, count = words.first, words.count
    for i in np.flatnonzero(count):
        a, c = first[i], count[i]
        if c >= k:
            part = roll[a : a + c - k + 1]
            if len(part) > 1:
                part = np.sort(part)
                keep = np.empty(len(part), np.bool_)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
        else:
            whole = int(c)
            for x in h[a : a + c].tolist():
                whole = (whole * 0x9FB21C651E98DF25 + x) & 0xFFFFFFFFFFFFFFFF
            part = mix(np.array([whole], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        out.append(part)
        sizes[i] = len(part)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; 0 for empty runs."""
    if values.dtype.kind == "f":
        total = np.zeros(len(offsets) - 1, values.dtype)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if len(full):
            total[full] = np.add.reduceat(values, offsets[full])
        return total
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
