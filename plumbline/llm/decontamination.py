"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND for every training passage.

Test items are the indexed side. An item's postings carry BM25 impacts divided by the item's own total, so a passage that
holds all of an item's words scores 1 whatever its length, and one threshold serves all items. Passages
are windows of 2L words that step by L, L being the longest item's length: each possible occurrence lies within one window.

A batch of documents is searched in three steps, none of which can lose a passage above the threshold:

1. Bounds by whole arrays: rare terms' block maxima are added up per half window and block of items; the common terms count with
   the most they can give any item of the block. Windows that stay below the threshold in every block are done.
2. Block-max WAND on the others: posting cursors sorted by item, a pivot by list maxima, a second test by block
   maxima that skips to the end of the shallowest block, and a full score only where both pass.
3. Verification on the words themselves: at least ``question`` of the question's distinct 5-word shingles and
   ``answer`` of the answer's distinct words must be in the window. An item without a separate answer is cut at its
   last sentence if that leaves five words on both sides, else before its last five words.

The index is broadcast in shards of at most ``shard_chars`` characters of item text, one pass over the documents for each shard.

Words are runs of ASCII letters and digits and of all non-ASCII bytes, A-Z lower-cased.
Defined results: null and wordless texts match nothing; items without words match nothing; a null doc_id or item_id is carried
as null, ids are of any type; repeated documents and items match on their own; very long texts are bounded some half windows
at a time; with an empty table on either side the result is empty.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .shared import respread, unused


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item given as one text."""
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text)]
    for e in reversed(ends):
        if min(len(text[:e].split()), len(text[e:].split())) >= 5:
            return text[:e], text[e:]
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    at = starts[-5] if len(starts) >= 10 else starts[len(starts) // 2] if len(starts) > 1 else len(text)
    return text[:at], text[at:]


#: Half windows whose bounds are held at a time.
STRIP = 4096


class Index:
    """Postings in item order with block maxima, for items given as (question, answer)."""

    def __init__(self, items: list[tuple[str, str]], block: int = 0, k1: float = 1.2, b: float = 0.75):
        self.block = block = block or max(2, -(-len(items) // 512))
        both = textbytes.Words(pa.array([f"{q} {a}" for q, a in items], pa.string()), textbytes.ALNUM_WORDS)
        h, doc = both.hashes(), both.doc()
        self.n, self.longest = len(items), max(1, int(both.count.max(initial=1)))
        self.terms, code = np.unique(h, return_inverse=True)
        key, tf = np.unique(code * max(1, self.n) + doc, return_counts=True)
        term, item = key // max(1, self.n), key % max(1, self.n)
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * both.count / max(1e-9, both.count.mean() if self.n else 1))
        weight = idf[term] * tf * (k1 + 1) / (tf + norm[item])
        self.impact = weight / np.bincount(item, weight, minlength=self.n)[item]
        self.item = item
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if len(term) else np.zeros(0)
        # block maxima, per term in block order
        self.blocks = -(-self.n // block) or 1
        bkey, first = np.unique(term * self.blocks + item // block, return_index=True)
        self.bmax = np.maximum.reduceat(self.impact, first) if len(term) else np.zeros(0)
        self.bterm, self.bblock = bkey // self.blocks, bkey % self.blocks
        self.bat = np.searchsorted(self.bterm, np.arange(len(self.terms) + 1))
        self.common = df > max(4, self.n // 20)
        given = np.bincount(item[self.common[term]], self.impact[self.common[term]], minlength=self.n)
        self.slack = np.maximum.reduceat(given, np.arange(0, self.n, block)) if self.n else np.zeros(1)
        self.parts, self.cache = [], {}
        for q, a in items:
            w = textbytes.Words(pa.array([q, a], pa.string()), textbytes.ALNUM_WORDS)
            s, o = textbytes.shingles(w)
            self.parts.append((s[: o[1]], np.unique(w.hashes()[w.first[1] :])))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, i, -1)

    def _postings(self, term: int) -> tuple[list[int], list[float], float, dict[int, float]]:
        """A term's items, impacts, list maximum and block maxima as plain Python values, made once."""
        got = self.cache.get(term)
        if got is None:
            a, b, c, d = self.at[term], self.at[term + 1], self.bat[term], self.bat[term + 1]
            got = self.cache[term] = (self.item[a:b].tolist(), self.impact[a:b].tolist(), float(self.most[term]), dict(zip(self.bblock[c:d].tolist(), self.bmax[c:d].tolist(), strict=True)))
        return got

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts for the distinct ``terms`` add up to the threshold."""
        low, out, end = threshold - 1e-9, [], self.n
        cursors = []  # [item, place, postings]
        for t in terms.tolist():
            p = self._postings(t)
            cursors.append([p[0][0], 0, p])

        def seek(c: list, item: int) -> None:
            items = c[2][0]
            c[1] = bisect_left(items, item, c[1])
            c[0] = items[c[1]] if c[1] < len(items) else end

        while True:
            cursors.sort(key=lambda c: c[0])
            while cursors and cursors[-1][0] >= end:
                cursors.pop()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2][2]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, head = item // self.block, cursors[: pivot + 1]
            if sum(c[2][3].get(block, 0.0) for c in head) < low:
                # no item up to the block's end or the next list's item can pass with these lists
                skip = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    skip = min(skip, cursors[pivot + 1][0])
                for c in head:
                    seek(c, max(skip, item + 1))
            elif cursors[0][0] == item:
                score = sum(c[2][1][c[1]] for c in head)
                if score >= low:
                    out.append((item, score))
                for c in head:
                    seek(c, item + 1)
            else:
                for c in head:
                    if c[0] < item:
                        seek(c, item)

    def search(self, words: textbytes.Words, threshold: float, question: float, answer: float) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of all verified matches, the best window of each pair."""
        length = self.longest
        halves = -(-words.count // length)
        base = np.concatenate([[0], np.cumsum(halves)])
        hashes = words.hashes()
        term = self.lookup(hashes)
        at = np.flatnonzero(term >= 0)
        if not len(at):
            return []
        row = np.searchsorted(words.first, at, side="right") - 1
        half = base[row] + (at - words.first[row]) // length
        # distinct (half, rare term), spread over the term's blocks, some halves at a time and the next one with them
        rare = ~self.common[term[at]]
        key = np.unique(half[rare] * len(self.terms) + term[at][rare])
        total = int(base[-1])
        last = np.zeros(total, np.bool_)
        last[base[1:][halves > 0] - 1] = True
        hits = []
        for begin in range(0, total, STRIP):
            n = min(STRIP, total - begin)
            a, b = np.searchsorted(key, [begin * len(self.terms), (begin + n + 1) * len(self.terms)])
            h, t = key[a:b] // len(self.terms) - begin, key[a:b] % len(self.terms)
            times = self.bat[t + 1] - self.bat[t]
            entry = np.arange(times.sum()) + np.repeat(self.bat[t] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
            bound = np.bincount(np.repeat(h, times) * self.blocks + self.bblock[entry], self.bmax[entry], minlength=(n + 1) * self.blocks).reshape(n + 1, self.blocks)
            both = bound[:-1] + np.where(last[begin : begin + n, None], 0.0, bound[1:])
            hits.append(begin + np.flatnonzero((both + self.slack >= threshold - 1e-9).any(axis=1)))
        hit = np.concatenate(hits)
        best: dict[tuple[int, int], tuple] = {}
        for w in hit.tolist():
            r = int(np.searchsorted(base, w, side="right")) - 1
            begin = int(words.first[r]) + (w - int(base[r])) * length
            end = min(begin + 2 * length, int(words.first[r + 1]))
            found = self.wand(np.unique(term[begin:end][term[begin:end] >= 0]), threshold)
            for item, score in found:
                q, a = self.parts[item]
                there = _shingles_of(hashes[begin:end])
                q_in = np.isin(q, there).mean() if len(q) else 1.0
                a_in = np.isin(a, hashes[begin:end]).mean() if len(a) else 1.0
                if len(q) + len(a) and q_in >= question and a_in >= answer:
                    best[r, item] = max(best.get((r, item), (0.0,)), (score, float(q_in), float(a_in)))
        return [(r, item, *v) for (r, item), v in sorted(best.items())]


def _shingles_of(h: np.ndarray, k: int = 5) -> np.ndarray:
    """All k-word shingles of a word sequence, and its shorter runs where a question may be shorter than k words."""
    n = len(h)
    out = []
    if n >= k:
        roll = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            roll += h[j : n - k + 1 + j] * np.uint64(pow(0x9FB21C651E98DF25, j, 1 << 64))
        out.append(textbytes.mix(roll))
    for c in range(1, k):
        whole = np.full(max(0, n - c + 1), c, np.uint64)
        for j in range(c):
            whole = whole * np.uint64(0x9FB21C651E98DF25) + h[j : n - c + 1 + j]
        out.append(textbytes.mix(whole ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(out)


def contaminated(
    df: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer_text: str | None = None,
    threshold: float = 0.6, question: float = 0.8, answer: float = 0.8, shard_chars: int = 8_000_000,
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document and test item found in it."""
    spark = df.sparkSession
    id_kind, item_kind = df.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    picked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("q"), (F.col(answer_text) if answer_text else F.lit(None).cast("string")).alias("a")).filter(F.col("q").isNotNull())
    chars = picked.agg(F.sum(F.length("q") + F.coalesce(F.length("a"), F.lit(0)))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    out = None
    for s in range(shards):
        shard = picked.filter(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "q"), F.lit(shards)) == s).toArrow().combine_chunks()
        pairs = [(q, a) if a is not None else split_item(q) for q, a in zip(shard.column("q").to_pylist(), shard.column("a").to_pylist(), strict=True)]
        use = sorted((i for i, p in enumerate(pairs) if p[0].strip() or p[1].strip()), key=lambda i: pairs[i])
        pairs, ids = [pairs[i] for i in use], shard.column("item_id").take(pa.array(use, pa.int64())).combine_chunks()
        shared = spark.sparkContext.broadcast((Index(pairs), ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = shared.value
            for whole in batches:
                for batch in textbytes.slices(whole, "text"):
                    found = index.search(textbytes.Words(batch.column(1), textbytes.ALNUM_WORDS), threshold, question, answer) if len(ids) else []
                    docs = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    columns = [docs, ids.take(pa.array([f[1] for f in found], pa.int64())), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def decontaminate(df: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``df`` in which no test item was found. Columns of any name pass through."""
    key = unused(df, "found")
    found = contaminated(df, items, doc_id=doc_id, **how).select(F.col("doc_id").alias(key)).distinct()
    return df.join(respread(found), F.col(doc_id).eqNullSafe(F.col(key)), "left_anti")
