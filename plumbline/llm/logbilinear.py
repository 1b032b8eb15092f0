"""Scoring texts with a log-bilinear neural language model trained by noise-contrastive estimation.

Tokens are words (A-Z lower-cased, runs of bytes other than space and 0x09-0x0D) and one end per text. Each
word belongs to one of ``CLASSES`` classes: the most frequent words and the end have their own, all others share classes by
their last two bytes. The network predicts a token's class from the classes of the two tokens before it:

    score(c | a, b) = (R[a] A + R[b] B) . Q[c] + bias[c]

and the smoothed counts spread a class over its words, so that log10 p(word) = log10 P(class | a, b) + log10((c + 0.1) / mass of the class).
All events, the one unknown word included, add up to 1. A score splits into one table for each context place, so batched matrix
products over all pairs of contexts are needed for the normalisers alone, which scoring reads from a table.

Counts (c, N, V) cover every training row: words are counted where they are read and added up by word. The
network is trained by every partition on its own rows, on every position of every document: each round takes the next
``stride``-th of them, so ``stride`` rounds take each one once. Noise is drawn
from the class masses; replicas are averaged by position counts, over ``rounds`` rounds.

Scoring looks words up in two tiers: words of at least a threshold count, at most ``table_size`` of them, are broadcast; the rest
of a document's words meet the full count table in one join.

Defined results: null text is the end token alone; a null doc_id is held out; repeated rows are scored one by one;
without training rows all scores are those of the smoothing alone; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .shared import crc_mod, respread, table

CLASSES, TAILS, DIM = 1024, 128, 24
SINGLES = CLASSES - TAILS
END = np.int64(0x0E0D)
SMOOTH = 0.1


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all tokens with the ends in place, and row offsets."""
    w = textbytes.Words(column, textbytes.SPACE_WORDS)
    h = w.hashes().view(np.int64)
    last, before = w.data[w.end - 1].astype(np.int64), w.data[np.maximum(w.end - 2, w.start)].astype(np.int64)
    tail = (last * 131 + before * 31) % 9973 % TAILS
    at = w.first + np.arange(w.rows + 1)
    every, tails = np.full(at[-1], END), np.zeros(at[-1], np.int64)
    words = np.ones(at[-1], np.bool_)
    words[at[1:] - 1] = False
    every[words], tails[words] = h, tail
    return every, tails, at


def word_counts(df: DataFrame, most: int = 400_000) -> DataFrame:
    """h, c, tail of every token of the texts; each task adds up its own before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged() -> tuple:
            h, n, t = (np.concatenate([x[k] for x in held]) for k in range(3))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(back, n).astype(np.int64), t[first]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["h", "c", "tail"])

        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                h, t, _ = _tokens(batch.column(0))
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, n, t[first]))
                size += len(u)
                if size > 2 * most:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > most:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    parts = df.select("text").mapInArrow(run, "h long, c long, tail long")
    return parts.groupBy("h").agg(F.sum("c").alias("c"), F.first("tail").alias("tail"))


class Vocabulary:
    """Frequent words, class masses and the size of the corpus."""

    def __init__(self, h: np.ndarray, c: np.ndarray, singles: np.ndarray, single_c: np.ndarray, tail_mass: np.ndarray, total: int, distinct: int):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.total, self.distinct = total, distinct
        self.whole = total + SMOOTH * (distinct + 1)
        self.single = np.sort(singles)
        mass = np.full(CLASSES, 1e-9)
        mass[: len(singles)] = single_c[np.argsort(singles)] + SMOOTH
        mass[SINGLES:] = tail_mass + SMOOTH / TAILS
        self.mass = mass
        self.own = np.full(len(self.h), -1)
        i = np.searchsorted(self.single, self.h)
        hit = (i < len(self.single)) & (self.single[np.minimum(i, max(0, len(self.single) - 1))] == self.h) if len(self.single) else np.zeros(len(self.h), np.bool_)
        self.own[hit] = i[hit]
        self.base = np.log10((self.c + SMOOTH) / self.whole)

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[i] == h, i, -1)

    def classes(self, found: np.ndarray, tails: np.ndarray) -> np.ndarray:
        own = np.where(found >= 0, self.own[found] if len(self.h) else -1, -1)
        return np.where(own >= 0, own, SINGLES + tails)

    def contexts(self, cls: np.ndarray, at: np.ndarray, end_class: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes one and two places before each token; a text begins after ends."""
        one, two = np.empty_like(cls), np.empty_like(cls)
        one[1:], two[2:] = cls[:-1], cls[:-2]
        start = at[:-1]
        one[start] = end_class
        two[start] = end_class
        second = start[np.diff(at) > 1] + 1
        two[second] = end_class
        return one, two


def vocabulary(counts: DataFrame, table_size: int) -> Vocabulary:
    size = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, distinct = size[0] or 0, size[1]
    step = F.floor(F.log2("c") * 4).cast("int")
    steps = sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    bound, used = None, 0
    for s, n in steps:
        used += n
        if used > table_size:
            break
        bound = s
    frequent = counts.filter(step >= bound).toPandas() if bound is not None else counts.limit(0).toPandas()
    top = frequent[frequent.h != END].sort_values(["c", "h"], ascending=[False, True]).head(SINGLES - 1)
    singles = np.append(top.h.to_numpy(np.int64), END)
    ends = frequent.loc[frequent.h == END, "c"]
    n_end = int(ends.iloc[0]) if len(ends) else int((counts.filter(F.col("h") == F.lit(int(END))).agg(F.sum("c")).first()[0]) or 0)
    mass = np.zeros(TAILS)
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        mass[r["tail"]] = r["c"] + SMOOTH * r["n"]
    np.subtract.at(mass, top["tail"].to_numpy(np.int64), top.c.to_numpy() + SMOOTH)
    if n_end:
        mass[0] -= n_end + SMOOTH  # the end was counted under tail class 0
    return Vocabulary(frequent.h.to_numpy(np.int64), frequent.c.to_numpy(np.int64), singles, np.append(top.c.to_numpy(np.int64), n_end), np.maximum(mass, 0), total, distinct)


class Network:
    SHAPES = ((CLASSES, DIM), (CLASSES, DIM), (CLASSES,), (DIM, DIM), (DIM, DIM))

    def __init__(self, noise: np.ndarray):
        rng = np.random.default_rng(5)
        self.parts = [rng.normal(0, 0.1, s).astype(np.float32) for s in self.SHAPES]
        self.parts[2] = np.log(noise).astype(np.float32)
        self.parts[3] = (np.eye(DIM) * 0.7).astype(np.float32)
        self.parts[4] = (np.eye(DIM) * 0.3).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for i, s in enumerate(self.SHAPES):
            n = int(np.prod(s))
            self.parts[i] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logs: the score of a class by the nearer and by the farther context (bias included), and the normaliser of each pair of contexts."""
        r, q, bias, near, far = self.parts
        p, f = r @ near @ q.T, r @ far @ q.T + bias
        p, f = p - p.max(axis=1, keepdims=True), f - f.max(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            return p, f, np.log(np.exp(p) @ np.exp(f).T)

    def log_prob(self, near: np.ndarray, far: np.ndarray, target: np.ndarray) -> np.ndarray:
        p, f, z = self.tables()
        return p[near, target] + f[far, target] - z[near, far]


def _by_class(classes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct classes and the sums of their rows."""
    order = np.argsort(classes.astype(np.uint16), kind="stable")
    classes = classes[order]
    first = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    return classes[first], np.add.reduceat(rows[order], first)


class Trainer:
    """One replica: minibatches of NCE with Adagrad."""

    def __init__(self, network: Network, noise: np.ndarray, seed: int, negatives: int = 64, rate: float = 0.15):
        self.net, self.rng, self.k, self.rate = network, np.random.default_rng(seed), negatives, rate
        self.edge = np.cumsum(noise)
        self.log_noise = np.log(negatives * noise).astype(np.float32)
        self.square = [np.full(p.shape, 0.1, np.float32) for p in network.parts]
        self.seen = 0

    def batch(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        r, q, bias, near, far = self.net.parts
        n = len(target)
        neg = np.minimum(np.searchsorted(self.edge, self.rng.random(self.k) * self.edge[-1]), CLASSES - 1)
        ra, rb = r[one], r[two]
        pred = ra @ near + rb @ far
        up = (pred * q[target]).sum(axis=1) + bias[target] - self.log_noise[target]
        down = pred @ q[neg].T + bias[neg] - self.log_noise[neg]
        g_up = (1 / (1 + np.exp(-np.clip(up, -30, 30))) - 1).astype(np.float32)
        g_down = (1 / (1 + np.exp(-np.clip(down, -30, 30)))).astype(np.float32)
        g_pred = g_up[:, None] * q[target] + g_down @ q[neg]
        g_q, g_bias, g_r = np.zeros_like(q), np.zeros_like(bias), np.zeros_like(r)
        with_bias = lambda g, x: np.concatenate([g[:, None] * x, g[:, None]], axis=1)
        down_rows = np.concatenate([g_down.T @ pred, g_down.sum(axis=0)[:, None]], axis=1)
        for classes, rows in ((target, with_bias(g_up, pred)), (neg, down_rows)):
            at, sums = _by_class(classes, rows)
            g_q[at] += sums[:, :-1]
            g_bias[at] += sums[:, -1]
        for classes, rows in ((one, g_pred @ near.T), (two, g_pred @ far.T)):
            at, sums = _by_class(classes, rows)
            g_r[at] += sums
        grads = [g_r, g_q, g_bias, ra.T @ g_pred, rb.T @ g_pred]
        for p, g, s in zip(self.net.parts, grads, self.square, strict=True):
            g /= n
            s += g * g * 100
            p -= self.rate * g * 10 / np.sqrt(s)
        self.seen += n


def picked(at: np.ndarray, turn: int, stride: int) -> np.ndarray:
    """Positions that a round trains on, counted from the start of each document."""
    place = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
    return np.flatnonzero(place % stride == turn % stride)


def train(df: DataFrame, vocab: Vocabulary, *, stride: int = 2, rounds: int = 2, size: int = 1024) -> Network:
    """df: text of the training rows."""
    spark = df.sparkSession
    noise = vocab.mass / vocab.mass.sum()
    net = Network(noise)
    end_class = int(np.searchsorted(vocab.single, END))
    shared = spark.sparkContext.broadcast(vocab)
    for turn in range(rounds):
        begin = spark.sparkContext.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], turn=turn, begin=begin) -> Iterator[pa.RecordBatch]:
            v = shared.value
            trainer = Trainer(Network(noise).load(begin.value), noise, 1000 * turn + TaskContext.get().partitionId())
            held: list[np.ndarray] = []
            for whole in batches:
                for batch in textbytes.slices(whole, "text"):
                    h, tails, at = _tokens(batch.column(0))
                    cls = v.classes(v.find(h), tails)
                    one, two = v.contexts(cls, at, end_class)
                    pick = picked(at, turn, stride)
                    held.append(np.stack([one[pick], two[pick], cls[pick]]))
                    rows = np.concatenate(held, axis=1)
                    full = rows.shape[1] // size * size
                    order = trainer.rng.permutation(full)
                    for i in range(0, full, size):
                        trainer.batch(*rows[:, order[i : i + size]])
                    held = [rows[:, full:]]
            if held and held[0].shape[1]:
                trainer.batch(*held[0])
            if trainer.seen:
                flat = trainer.net.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * trainer.seen), pa.array(np.full(len(flat), float(trainer.seen)))], ["i", "x", "w"])

        mean = df.select("text").mapInArrow(run, "i long, x double, w double").groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).toPandas()
        if len(mean):
            net.load(mean.sort_values("i").x.to_numpy())
    return net


def _gains(net: Network, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """log10 of P(class | contexts) over the class's share, as two tables and the normalisers; the same of the unknown word for each pair of contexts."""
    p, f, z = net.tables()
    tails = (SMOOTH / TAILS / v.mass[SINGLES:]).astype(np.float32)
    with np.errstate(divide="ignore"):
        unknown = np.log10((np.exp(p[:, SINGLES:]) * tails) @ np.exp(f[:, SINGLES:]).T) - np.log10(SMOOTH / v.whole)
    ten = np.float32(1 / np.log(10))
    return p * ten, f * ten - np.log10(v.mass / v.whole).astype(np.float32), z * ten, unknown.astype(np.float32)


def score(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fold: int = 10, table_size: int = 300_000, stride: int = 2, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = df.sparkSession
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (crc_mod(doc_id, fold) == 0).alias("held_out"))
    learn = rows.filter(~F.col("held_out")).select("text")
    counts = table(word_counts(learn), "word-counts")
    vocab = vocabulary(counts, table_size)
    net = train(learn, vocab, stride=stride, rounds=rounds) if vocab.total else Network(np.full(CLASSES, 1 / CLASSES))
    shared = spark.sparkContext.broadcast((vocab, *_gains(net, vocab)))
    end_class = int(np.searchsorted(vocab.single, END))
    whole = vocab.whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, by_near, by_far, normal, unknown = shared.value
        uid = TaskContext.get().partitionId() << 33
        for big in batches:
            for batch in textbytes.slices(big, "text"):
                n = batch.num_rows
                h, tails, at = _tokens(batch.column(1))
                found = v.find(h)
                cls = v.classes(found, tails)
                one, two = v.contexts(cls, at, end_class)
                z = normal[one, two].astype(np.float64)
                known = by_near[one, cls] + by_far[two, cls] - z if v.total else np.zeros(len(h))
                lost = unknown[one, two] - z if v.total else np.zeros(len(h))
                here = found >= 0
                base = np.where(here, v.base[found] if len(v.h) else 0.0, 0.0)
                doc = np.repeat(np.arange(n), np.diff(at))
                rest = np.flatnonzero(~here)
                order = rest[np.lexsort((h[rest], doc[rest]))]
                new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(order) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(order)))
                add = lambda x: np.add.reduceat(x[order], new) if len(order) else np.zeros(0)  # noqa: E731, B023
                m = len(new)
                ids = uid + np.arange(n)
                none = pa.nulls(m, batch.column(0).type)
                both = lambda a, b: pa.array(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays(
                    [
                        both(ids, ids[doc[order[new]]]), both(textbytes.mix(ids.astype(np.uint64)).view(np.int64), h[order[new]]), both(np.zeros(n, np.int64), times),
                        both(textbytes.run_sums(np.where(here, known, 0.0), at), add(known)), both(np.zeros(n), add(lost)),
                        both(textbytes.run_sums(base, at), np.zeros(m)), both(textbytes.run_sums(here, at), np.zeros(m, np.int64)),
                        both(np.diff(at), np.zeros(m, np.int64)), pa.concat_arrays([batch.column(0), none]), pa.concat_arrays([batch.column(2), pa.nulls(m, pa.bool_())]),
                    ],
                    ["uid", "h", "times", "known", "lost", "base", "n_known", "n_tokens", "doc_id", "held_out"],
                )
                uid += n

    events = rows.mapInArrow(run, f"uid long, h long, times long, known double, lost double, base double, n_known long, n_tokens long, doc_id {kind}, held_out boolean")
    # A document's own row has times 0 and a key of its own; it passes the join without a partner.
    rare = respread(counts.select(F.col("h").alias("g"), "c"))
    joined = events.join(rare, (F.col("h") == F.col("g")) & (F.col("times") > 0), "left")
    word = F.col("times") > 0
    share = F.log10((F.coalesce(F.col("c"), F.lit(0)) + F.lit(SMOOTH)) / F.lit(whole)) * F.col("times")
    sums = joined.select(
        "uid", "doc_id", "held_out", "n_tokens",
        F.when(word & F.col("c").isNotNull(), F.col("times")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(word, share).otherwise(F.col("base")).alias("base"),
        F.when(word & F.col("c").isNull(), F.col("lost")).otherwise(F.col("known")).alias("gain"),
    )
    out = sums.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("gain").alias("gain"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(vocab.total)).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))
