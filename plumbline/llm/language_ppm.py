"""Language identification by prediction by partial matching.

One frozen byte model per language: context trees of orders 0 to 3 with method C escapes
(a context seen n times with d distinct successors gives a seen byte c/(n+d) and the escape d/(n+d);
an unseen context costs nothing; below order 0 all 256 bytes are alike; no exclusions). A text's
code length under a model is exact: the sum over all of its bytes, the first ones after three newlines.
The shortest code wins. ``score`` is the winner's posterior under equal priors, 0 to 1.

Because the statistics are frozen, the trees are flattened into tables of code lengths: order-3
grams that any language has seen, then order-2 grams and escapes, then dense order-1 tables. Scoring is
a gather per byte; a gram that no tree holds falls through the tiers as the tree walk would.

Training reads a bounded sample of labelled rows: about ``docs_per_lang`` documents for each language there is,
chosen by id hash, whole documents up to ``bytes_per_lang`` bytes (counted before texts are fetched; one text alone is cut there). Languages are flattened in groups of ``GROUP``, so
that tables grow with the number of languages and not with its square. Everything else covers all rows and whole texts.

Defined results: null text or a text without a letter gives ``und`` with score 0; a null doc_id is
held out; rows without lang are scored but not learned from; with nothing to learn every row is ``und``;
ties go to the smallest language name; repeated rows give repeated rows; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textbytes
from .shared import crc_mod, unused

#: A-Z become a-z and all digits one byte, so that case and numbers don't dilute the contexts.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
PAD = 10
#: Languages in one set of flattened tables.
GROUP = 32
#: Columns that ``identify`` adds.
NEW = ("ppm_held", "ppm_lang", "ppm_score")
_MUL = np.uint32(0x9E3779B1)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Codes of all spans of k bytes."""
    out = np.zeros(len(data) - k + 1, np.uint32)
    for j in range(k):
        out = (out << np.uint32(8)) | data[j : len(data) - k + 1 + j]
    return out


class _Tree:
    """Counts of one language at one order: sorted grams with counts, sorted contexts with totals."""

    def __init__(self, grams: np.ndarray):
        self.gram, self.n = np.unique(grams, return_counts=True)
        self.ctx, first = np.unique(self.gram >> np.uint32(8), return_index=True)
        self.total = np.add.reduceat(self.n, first) if len(first) else np.zeros(0, np.int64)
        self.distinct = np.diff(np.append(first, len(self.gram)))

    def code(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after its context; ``lower`` has the bits one order below."""
        if not len(self.gram):
            return lower
        c = np.minimum(np.searchsorted(self.ctx, grams >> np.uint32(8)), len(self.ctx) - 1)
        known = self.ctx[c] == grams >> np.uint32(8)
        g = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        seen = self.gram[g] == grams
        whole = (self.total[c] + self.distinct[c]).astype(float)
        return np.where(seen, np.log2(whole / self.n[g]), np.where(known, np.log2(whole / self.distinct[c]) + lower, lower))

    def escape(self, ctx: np.ndarray) -> np.ndarray:
        if not len(self.gram):
            return np.zeros(len(ctx))
        c = np.minimum(np.searchsorted(self.ctx, ctx), len(self.ctx) - 1)
        return np.where(self.ctx[c] == ctx, np.log2((self.total[c] + self.distinct[c]) / self.distinct[c]), 0.0)


class Model:
    """Flattened trees of all languages."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        pad = bytes([PAD] * 3)
        trees = []
        for lang in self.langs:
            grams: dict[int, list[np.ndarray]] = {k: [] for k in (1, 2, 3, 4)}
            for text in texts[lang]:
                data = FOLD[np.frombuffer(pad + text, np.uint8)]
                for k in grams:
                    grams[k].append(_grams(data[4 - k :], k))
            trees.append([_Tree(np.concatenate(grams[k]) if grams[k] else np.zeros(0, np.uint32)) for k in (1, 2, 3, 4)])
        union = lambda arrays: np.unique(np.concatenate([*arrays, np.zeros(0, np.uint32)])).astype(np.uint32)
        self.keys4 = union([t[3].gram for t in trees])
        self.keys3 = union([x for t in trees for x in (t[2].gram, t[3].ctx)])
        pairs, bytes_ = np.arange(65536, dtype=np.uint32), np.arange(256, dtype=np.uint32)
        order0 = [t[0].code(bytes_, np.full(256, 8.0)) for t in trees]
        order1 = [t[1].code(pairs, o[pairs & 255]) for t, o in zip(trees, order0, strict=True)]
        order2 = lambda t, low, g: t[2].code(g, low[g & np.uint32(65535)])
        stack = lambda cols, n: np.ascontiguousarray(np.array(cols, np.float64).reshape(len(trees), n).T.astype(np.float32))
        self.dense = stack(order1, 65536)
        self.dense_escape = stack([t[2].escape(pairs) for t in trees], 65536)
        self.codes3 = stack([order2(t, o, self.keys3) for t, o in zip(trees, order1, strict=True)], len(self.keys3))
        self.escape3 = stack([t[3].escape(self.keys3) for t in trees], len(self.keys3))
        low = self.keys4 & np.uint32(0xFFFFFF)
        codes4 = stack([t[3].code(self.keys4, order2(t, o, low)) for t, o in zip(trees, order1, strict=True)], len(self.keys4))
        self.codes4 = np.vstack([codes4, np.zeros((1, len(trees)), np.float32)])
        self._hash()

    def _hash(self) -> None:
        """Open addressing over the order-3 grams."""
        self.bits = max(4, int(len(self.keys4) * 4).bit_length())
        size = 1 << self.bits
        self.slot = np.full(size, -1, np.int32)
        left = np.arange(len(self.keys4))
        at = (self.keys4 * _MUL) >> np.uint32(32 - self.bits)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = free  # the last writer of a slot wins
            left = left[self.slot[at[left]] != left]
            at[left] = (at[left] + 1) & np.uint32(size - 1)
        self.slot_key = np.where(self.slot >= 0, self.keys4[np.maximum(self.slot, 0)] if len(self.keys4) else 0, 0).astype(np.uint32)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each gram in ``codes4``, or -1."""
        at = (grams * _MUL) >> np.uint32(32 - self.bits)
        out = np.where(self.slot_key[at] == grams, self.slot[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & np.uint32((1 << self.bits) - 1)
            hit = self.slot_key[at[open_]] == grams[open_]
            out[open_[hit]] = self.slot[at[open_[hit]]]
            open_ = open_[~hit & (self.slot[at[open_]] >= 0)]
        return out

    def fall(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of grams that no order-3 tree holds."""
        ctx, low = grams >> np.uint32(8), grams & np.uint32(0xFFFFFF)

        def row(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(self.keys3):
                return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.bool_)
            i = np.minimum(np.searchsorted(self.keys3, keys), len(self.keys3) - 1)
            return i, self.keys3[i] == keys

        i, seen = row(low)
        out = self.dense[low & np.uint32(65535)] + self.dense_escape[low >> np.uint32(8)]
        out[seen] = self.codes3[i[seen]]
        i, seen = row(ctx)
        out[seen] += self.escape3[i[seen]]
        return out

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns)."""
        raw, at = textbytes.text_bytes(column)
        rows = len(at) - 1
        start = at[:-1] + 3 * np.arange(rows)
        data = np.full(len(raw) + 3 * rows, PAD, np.uint8)
        inside = np.ones(len(data), np.bool_)
        for j in range(3):
            inside[start + j] = False
        data[inside] = FOLD[raw]
        out = np.zeros((rows, len(self.langs)))
        if len(data) < 4 or not len(raw):
            return out
        gram = _grams(data, 4)
        found = self.find(gram)
        inside = inside[3:]
        found[~inside] = len(self.codes4) - 1
        bits = self.codes4[found]
        miss = np.flatnonzero(found < 0)
        if len(miss):
            bits[miss] = self.fall(gram[miss])
        full = np.flatnonzero(at[1:] > at[:-1])
        out[full] = np.add.reduceat(bits, start[full], axis=0, dtype=np.float64)
        return out


class Models:
    """Models of any number of languages, in groups by name."""

    def __init__(self, texts: dict[str, list[bytes]], group: int = GROUP):
        self.langs = sorted(texts)
        parts = [self.langs[i : i + group] for i in range(0, len(self.langs), group)]
        self.groups = [Model({x: texts[x] for x in part}) for part in parts]

    def lengths(self, column: pa.Array) -> np.ndarray:
        """As ``Model.lengths``, group by group."""
        return np.hstack([m.lengths(column) for m in self.groups])


def _has_letter(column: pa.Array) -> np.ndarray:
    raw, at = textbytes.text_bytes(column)
    ascii_ = (raw >= 65) & (raw <= 122) & ((raw <= 90) | (raw >= 97))
    out = textbytes.run_sums(ascii_, at) > 0
    for i in np.flatnonzero(~out & (at[1:] > at[:-1])):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out


def train(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 5, docs_per_lang: int = 400, bytes_per_lang: int = 1_000_000) -> Models:
    """Fit on rows whose crc32(doc_id as text) mod ``fold`` is not 0."""
    rows = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), crc_mod(doc_id, fold).alias("m"))
    rows = rows.filter((F.col("m") != 0) & F.col("t").isNotNull() & F.col("l").isNotNull())
    sizes = rows.groupBy("l").count().collect()
    if not sizes:
        return Models({})
    dealt = df.sparkSession.createDataFrame([(r.l, min(1.0, docs_per_lang / r["count"])) for r in sizes], "g string, share double")
    place = F.pmod(F.xxhash64("i"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    sample = rows.join(F.broadcast(dealt), F.col("l") == F.col("g")).filter(place < F.col("share"))
    # Bytes are added up before any text is fetched: texts past a language's bound stay where they are.
    sample = sample.select("l", place.alias("p"), F.xxhash64("t").alias("x"), F.octet_length("t").cast("long").alias("n"), "t")
    before = W.partitionBy("l").orderBy("p", "x").rowsBetween(W.unboundedPreceding, -1)
    narrow = sample.select("l", "p", "x", "n").distinct().withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("used") < bytes_per_lang)
    picked = narrow.select(F.col("l").alias("l2"), F.col("p").alias("p2"), F.col("x").alias("x2"), "used")
    same = (F.col("l") == F.col("l2")) & (F.col("p") == F.col("p2")) & (F.col("x") == F.col("x2"))
    text_part = F.substring(F.col("t").cast("binary"), 1, bytes_per_lang)  # one text alone may exceed the bound
    texts: dict[str, list[bytes]] = {r.l: [] for r in sizes}
    fetched = sample.join(F.broadcast(picked), same).select("l", "used", "p", "x", text_part.alias("t")).dropDuplicates(["l", "p", "x"])
    for r in fetched.orderBy("l", "used", "p", "x").collect():
        texts[r.l].append(bytes(r.t))
    return Models(texts)


def identify(df: DataFrame, model: Model | Models, *, doc_id: str = "doc_id", text: str = "text", fold: int = 5, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; with ``keep`` the last three, under ``NEW`` or the next names free, after all columns of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own_id, own_text, new_held, new_lang, new_score = (unused(df, n) for n in ("ppm_id", "ppm_text", *NEW))
    source = df.withColumns({own_id: F.col(doc_id), own_text: F.col(text), new_held: crc_mod(doc_id, fold) == 0})
    if not keep:
        source = source.select(own_id, own_text, new_held)
    kept = df.columns if keep else []
    source = source.toDF(*[f"c{i}" for i in range(len(kept))], own_id, own_text, new_held)  # columns of any name pass the Arrow stage by number
    fields = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] or [f"doc_id {df.schema[doc_id].dataType.simpleString()}"]
    names = [*(f"c{i}" for i in range(len(kept))), new_held, new_lang, new_score] if keep else ["doc_id", "held_out", "lang_pred", "score"]
    schema = ", ".join(fields) + ", " + ", ".join(f"{n} {t}" for n, t in zip(names[-3:], ("boolean", "string", "double"), strict=True))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in textbytes.slices(whole, own_text):
                column = batch.column(batch.schema.get_field_index(own_text))
                lang = np.full(batch.num_rows, "und", object)
                sure = np.zeros(batch.num_rows)
                if m.langs:
                    bits = m.lengths(column)
                    best = bits.argmin(axis=1)
                    p = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                    known = _has_letter(column)
                    lang[known] = np.array(m.langs, object)[best[known]]
                    sure[known] = p[known]
                own = [batch.column(i) for i in range(len(kept))] or [batch.column(0)]
                held = batch.column(batch.schema.get_field_index(new_held))
                yield pa.RecordBatch.from_arrays([*own, held, pa.array(lang, pa.string()), pa.array(sure)], names)

    return source.mapInArrow(score, schema).toDF(*(kept or ["doc_id"]), *names[-3:])


def reject_unknown(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose language is recognised: some letter, and a posterior of at least ``least``. Columns of any name pass through."""
    scored = identify(df, train(df, doc_id=doc_id, text=text, lang=lang), doc_id=doc_id, text=text, keep=True)
    sure = (F.col(unused(df, NEW[1])) != "und") & (F.col(unused(df, NEW[2])) >= least)
    return scored.filter(sure).select(*[F.col(f"`{c}`") for c in df.columns])
