"""Exact substring deduplication: every byte covered by a string of ``length`` bytes that occurs elsewhere goes.

Global classes first, Burrows-Wheeler merging inside them. No suffix is ever sorted against the whole corpus:

1. Every string of ``length`` bytes belongs to a cell of neighbouring starts around its content-defined anchor (anchors.py).
   Equal strings lie in cells with equal cores, the bytes that all strings of the cell share. A cell whose core occurs
   once holds no repeat. These counts, as all others, are pre-aggregated by hash.
2. Cells of equal core and equal bytes form a class. A class of two cells is repeated all over.
3. Where classes differ around a common core, one copy of each class is fetched. The strings of all classes of some
   cores go to one task, as rows of ``length``/``gram`` symbols; shards of them are transformed and merged by interleave
   refinement (bwt.py), and the repeated intervals among whole strings are the repeats.
4. A core with more than ``crowd`` classes is never gathered: its classes are cut into finer cells of ``fine`` starts, which meet by
   hash like those of step 1, and what is still undecided meets string by string, as counts by a 128-bit hash.

Found runs are joined back to the occurrences of their class, collected per document, and cut from the text.
Cells, classes and fine strings are compared by 64-bit hashes (128-bit for single strings).

Defined results: null text counts as empty; equal rows are occurrences of each other; rows that share a doc_id but not the text are
separate documents; a null doc_id is carried; texts shorter than ``length`` lose nothing; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, textbytes
from .anchors import anchors, cells
from .shared import respread, table


def _runs(docs: DataFrame, length: int, k: int, parts: int) -> DataFrame:
    """h (core), c (bytes), d (document), p, q (first and last start), j (anchor's distance from p) of all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                raw, at = textbytes.text_bytes(batch.column(1))
                t, p, q, j, core, bytes_ = anchors(raw, at, length, k, parts)
                d = batch.column(0).to_numpy()[t]
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(bytes_), pa.array(d), *(pa.array(x.astype(np.int32)) for x in (p, q, j))], ["h", "c", "d", "p", "q", "j"])

    return docs.select("d", "text").mapInArrow(run, "h long, c long, d long, p int, q int, j int")


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """h, c, m, n, j, piece: the bytes of one cell of each wanted class (h, c, n, m, at)."""
    lists = wanted.groupBy("at.d").agg(F.collect_list(F.struct("h", "c", "n", "m", "at.p", "at.q", "at.j")).alias("list")).withColumnRenamed("d", "w")
    rows = docs.join(respread(lists), F.col("d") == F.col("w")).select("text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbytes.slices(whole, "text", 1 << 20):
                raw, at = textbytes.text_bytes(batch.column(0))
                column = batch.column(1)
                each = column.flatten()
                row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
                f = {n: each.field(i) for i, n in enumerate(("h", "c", "n", "m", "p", "q", "j"))}
                start = at[row] + f["p"].to_numpy()
                end = at[row] + f["q"].to_numpy() + length
                pieces = pa.array([raw[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([f["h"], f["c"], f["n"], f["m"], f["j"], pieces], ["h", "c", "n", "m", "j", "piece"])

    return rows.mapInArrow(run, "h long, c long, n long, m long, j int, piece binary")


def _strings(pieces: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of the pieces as rows of symbols (grams' hashes), with piece number and start."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    at = np.concatenate([[0], np.cumsum(size)])
    n = size - length + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    grams = textbytes.SpanHash(raw).windows(gram)
    rows = grams[(at[piece] + start)[:, None] + gram * np.arange(length // gram)[None, :]]
    return rows, piece, start


def _ranges(piece: np.ndarray, start: np.ndarray, alive: np.ndarray, pieces: int) -> list[list[int]]:
    """Runs of alive starts of each piece as a flat list first, last, first, last ..."""
    out: list[list[int]] = [[] for _ in range(pieces)]
    hit = np.flatnonzero(alive)
    if len(hit):
        new = np.append(True, (piece[hit][1:] != piece[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1))
        lo = hit[new]
        hi = hit[np.append(new[1:], True)]
        for i, a, b in zip(piece[lo].tolist(), start[lo].tolist(), start[hi].tolist(), strict=True):
            out[i] += [a, b]
    return out


def _merged(fetched: DataFrame, length: int, gram: int) -> DataFrame:
    """h, c, ranges of the classes with repeated strings, by Burrows-Wheeler merging within groups of cores."""
    rows = fetched.select("h", "c", "piece").repartition("h").sortWithinPartitions("h", "c")

    def search(h: list[int], c: list[int], pieces: list[bytes]) -> pa.RecordBatch:
        strings, piece, start = _strings(pieces, length, gram)
        # the core is a symbol of its own in front, so that strings only meet within their core
        core = np.array(h, np.int64).view(np.uint64)[piece][:, None]
        found = _ranges(piece, start, bwt.repeated(np.concatenate([textbytes.mix(core), strings], axis=1)), len(h))
        keep = [i for i, r in enumerate(found) if r]
        return pa.RecordBatch.from_arrays([pa.array([h[i] for i in keep], pa.int64()), pa.array([c[i] for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.list_(pa.int32()))], ["h", "c", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: list[int] = []
        c: list[int] = []
        pieces: list[bytes] = []
        strings = 0
        for batch in batches:
            for x, y, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if h and x != h[-1] and strings >= 12_000:
                    yield search(h, c, pieces)
                    h, c, pieces, strings = [], [], [], 0
                if h and (h[-1], c[-1]) == (x, y):
                    continue
                h.append(x)
                c.append(y)
                pieces.append(z)
                strings += len(z) - length + 1
        if h:
            yield search(h, c, pieces)

    return rows.mapInArrow(run, "h long, c long, ranges array<int>")


def _crowded(fetched: DataFrame, length: int, reach: int, fine: int) -> DataFrame:
    """The same for classes of crowded cores, by finer cells and then single strings that meet by hash."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                raw, at = textbytes.text_bytes(part.column(3))
                first = at[:-1]
                run, lo, hi, core, whole = cells(raw, first, at[1:] - length, first + part.column(2).to_numpy(), length, reach, fine)
                pieces = [raw[a : b + length].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                take = pa.array(run)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array((lo - first[run]).astype(np.int32)), pa.array((hi - first[run]).astype(np.int32)), pa.array(core), pa.array(whole), pa.array(pieces, pa.binary())], ["h", "c", "lo", "hi", "h2", "c2", "piece"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                raw, at = textbytes.text_bytes(part.column(2))
                n = np.diff(at) - length + 1
                row = np.repeat(np.arange(len(n)), n)
                start = at[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = [pa.array(textbytes.SpanHash(raw, b).spans(start, start + length).view(np.int64)) for b in (True, False)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*w, part.column(0).take(take), part.column(1).take(take), pa.array((start - at[row]).astype(np.int32))], ["w1", "w2", "h2", "c2", "i"])

    small = table(fetched.select("h", "c", "j", "piece").mapInArrow(split, "h long, c long, lo int, hi int, h2 long, c2 long, piece binary"), "fine-cells")
    kinds = table(small.groupBy("h2", "c2").agg(F.count(F.lit(1)).alias("n2"), F.first("piece").alias("piece")), "fine-classes")
    both = respread(kinds.groupBy("h2").agg(F.count(F.lit(1)).alias("m2")).filter(F.col("m2") > 1)).withColumnRenamed("h2", "g2")
    strings = table(kinds.join(both, F.col("h2") == F.col("g2")).select("h2", "c2", "piece").mapInArrow(single, "w1 long, w2 long, h2 long, c2 long, i int"), "strings")
    twice = respread(strings.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("t")).filter(F.col("t") > 1)).select(F.col("w1").alias("v1"), F.col("w2").alias("v2"))
    alive = strings.join(twice, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).groupBy("h2", "c2").agg(F.collect_list("i").alias("starts"))
    full = kinds.filter(F.col("n2") > 1).select("h2", "c2", F.lit(None).cast("array<int>").alias("starts"))
    rest = alive.join(full.select(F.col("h2").alias("f1"), F.col("c2").alias("f2")), (F.col("h2") == F.col("f1")) & (F.col("c2") == F.col("f2")), "left_anti")
    known = respread(full.union(rest.select("h2", "c2", "starts"))).select(F.col("h2").alias("k1"), F.col("c2").alias("k2"), "starts")
    hit = small.join(known, (F.col("h2") == F.col("k1")) & (F.col("c2") == F.col("k2")))
    pair = F.when(F.col("starts").isNull(), F.array("lo", "hi")).otherwise(F.flatten(F.transform("starts", lambda i: F.array(i + F.col("lo"), i + F.col("lo")))))
    return hit.select("h", "c", pair.alias("r")).groupBy("h", "c").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def repeated_bytes(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, k: int = 64, parts: int = 4, gram: int = 100, crowd: int = 128, fine: int = 10, spans: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with ``spans`` the removed runs as (start, end) pairs too."""
    if length % gram or k > length:
        raise ValueError("gram must divide length, and k not exceed it")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.lit(3), doc_id, text).alias("d"))
    runs = table(_runs(docs, length, k, parts), "cells")
    twice = respread(runs.groupBy("h").agg(F.count(F.lit(1)).alias("t")).filter(F.col("t") > 1)).select(F.col("h").alias("g"))
    hit = table(runs.join(twice, F.col("h") == F.col("g")).drop("g"), "repeated-cells")
    classes = table(hit.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "p", "q", "j")).alias("at")), "cell-classes")
    several = respread(classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)).withColumnRenamed("h", "g")
    fetched = table(_fetch(docs, classes.join(several, F.col("h") == F.col("g")).drop("g"), length), "cell-bytes")
    found = _merged(fetched.filter(F.col("m") <= crowd), length, gram)
    crowded = fetched.filter(F.col("m") > crowd).dropDuplicates(["h", "c"])
    if not crowded.isEmpty():
        found = found.union(_crowded(crowded, length, length - k, fine))
    # a class of two cells is repeated all over, whatever else was found about it
    full = classes.filter(F.col("n") > 1).select("h", "c", F.lit(None).cast("array<int>").alias("ranges"))
    single = classes.filter(F.col("n") == 1).select(F.col("h").alias("s1"), F.col("c").alias("s2"))
    part = found.join(single, (F.col("h") == F.col("s1")) & (F.col("c") == F.col("s2")), "left_semi")
    known = respread(full.union(part)).select(F.col("h").alias("k1"), F.col("c").alias("k2"), "ranges")
    pairs = F.when(F.col("ranges").isNull(), F.array("p", "q")).otherwise(F.transform("ranges", lambda x: x + F.col("p")))
    where = hit.join(known, (F.col("h") == F.col("k1")) & (F.col("c") == F.col("k2"))).select("d", pairs.alias("r")).groupBy("d").agg(F.flatten(F.collect_list("r")).alias("starts"))
    rows = docs.join(respread(where).withColumnRenamed("d", "w"), F.col("d") == F.col("w"), "left").select("doc_id", "text", "starts")
    kind = df.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                raw, at = textbytes.text_bytes(batch.column(1))
                out: list[tuple] = []
                for i in range(batch.num_rows):
                    own = raw[at[i] : at[i + 1]]
                    starts = batch.column(2)[i]
                    removed = []
                    if starts.is_valid:
                        mark = np.zeros(len(own) + 1, np.int32)
                        s = starts.values.to_numpy()
                        np.add.at(mark, s[0::2], 1)
                        np.add.at(mark, s[1::2] + length, -1)
                        gone = np.cumsum(mark)[:-1] > 0
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                        removed, own = edge.tolist(), own[~gone]
                    total = sum(removed[1::2]) - sum(removed[0::2])
                    out.append((len(own) + total, total, len(removed) // 2, hashlib.sha256(own.tobytes()).hexdigest(), removed))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
                columns = [batch.column(0), *(pa.array([o[j] for o in out], t) for j, t in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(columns[: 5 + spans], names[: 5 + spans])

    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<long>" * spans)
