"""Deduplication, decontamination, mixing, archives and the pipeline against brute force on small fixtures."""

import hashlib
import io
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bwt, decontamination, line_dedup, mixing, near_duplicates, suffix_dedup, warc
from plumbline.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, size string"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", len(t or ""), 1, "x") for i, t in enumerate(texts)], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 640)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(texts, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for copies in (90, 20, 4):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(200)] = rng.choice(vocabulary)
            texts.append(" ".join(x))
    common = [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(60):
        x = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 30, 100]))]
        texts.append(" ".join(x + common if len(x) > 20 else x))
    texts += [None, "", "a", "a", "A", "a b", "b a", None, "z " * 20_000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("leaf", "most"), [(6, 1 << 30), (16, 1 << 30), (512, 2000), (512, 4_000_000)])
def test_near_duplicates(spark, near_texts, leaf, most):
    got = near_duplicates.near_duplicates(docs(spark, near_texts), leaf=leaf, most=most).collect()
    assert sorted(tuple(r) for r in got) == brute_near(near_texts, 85)


def test_near_duplicate_edges(spark):
    frame = docs(spark, ["a b c d e f", "a b c d e f"])
    odd = frame.union(frame).union(spark.createDataFrame([(None, "a b c d e f", None, None, None, None, None)], DOCS))
    got = near_duplicates.near_duplicates(odd).collect()
    assert len(got) == 5 and [r.kept for r in got if r.doc_id is None] == [True] and sum(r.kept for r in got if r.doc_id == 1) == 0
    assert near_duplicates.near_duplicates(frame.filter("doc_id > 5")).count() == 0
    assert near_duplicates.drop_near_duplicates(frame).columns == frame.columns


def test_bwt_merge_equals_sorting():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = int(rng.integers(2, 30)), int(rng.integers(1, 6))
        s = rng.integers(5, 8, size=(n, m))
        d = np.unique(s, return_inverse=True)[1].reshape(n, m) + 1
        k = max(1, n // 2)
        merged = bwt.merge(bwt.build(d[:k]), bwt.build(d[k:]), m)
        suffix = lambda e: (d[e // (m + 1)].tolist()[e % (m + 1) :], e // (m + 1))  # noqa: B023, E731
        assert merged.order.tolist() == sorted(range(n * (m + 1)), key=suffix)
        _, back, times = np.unique(s, axis=0, return_inverse=True, return_counts=True)
        assert (bwt.repeated(s, int(rng.integers(2, 6))) == (times[back.ravel()] > 1)).all()


def brute_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 1000])
def test_repeated_bytes(spark, crowd):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(6)]
    texts = [None, "", "x"]
    for _ in range(200):
        t = ""
        for _ in range(rng.randint(0, 5)):
            b, a = rng.choice(base), rng.randint(0, 200)
            t += rng.choice([b[a : a + rng.randint(5, 120)], "".join(rng.choice("xyz") for _ in range(rng.randint(1, 60))), "ab" * rng.randint(1, 40)])
        texts.append(t)
    texts.append(texts[5])
    got = suffix_dedup.repeated_bytes(docs(spark, texts), length=40, k=16, gram=10, parts=3, fine=4, crowd=crowd).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_spans(texts, 40)


def test_repeated_bytes_of_equal_rows(spark):
    frame = docs(spark, ["q" * 30 + "".join(map(str, range(100)))])
    got = suffix_dedup.repeated_bytes(frame.union(frame), length=40, k=16, gram=10).collect()
    assert len(got) == 2 and all(r.n_removed == r.n_bytes for r in got)
    assert suffix_dedup.repeated_bytes(frame.filter("doc_id > 5"), length=40, k=16, gram=10).count() == 0


def test_simhash_and_lines(spark):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = []
    for i in range(40):
        x = list(base)
        if i % 2:
            x[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(x) + "\nshort line")
    texts += [None, "", " ".join(rng.choice(vocabulary) for _ in range(40_000)), "One two three four five six", "one two three four five SIX ", "\n\n"]
    texts.append(texts[-4] + " tail")
    frame = docs(spark, texts)
    lines = line_dedup.lines_of(frame.select(line_dedup.row_hash("doc_id", "text").alias("d"), frame.doc_id.alias("id"), "text"))
    hashes = {r.w: r.x for r in lines.selectExpr("explode(split(line, ' ')) w").distinct().select("w", line_dedup.word_hash(F.col("w")).alias("x")).collect()}
    text = {(r.id, r.pos): r.line for r in lines.collect()}
    for r in line_dedup.keyed_lines(lines).collect():
        x = [hashes[w] for w in text[r.id, r.pos].split(" ")]
        n, x = len(x), sorted(x)[: line_dedup.WORDS]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x))
        assert r.sim == (None if n < 5 else want - (1 << 64) if want >> 63 else want)
    # brute force over all pairs of distinct lines, by edit similarity alone
    keys = sorted(text)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    def alike(a, b):
        x, y = text[a], text[b]
        if x == y:
            return True
        if min(len(x.split(" ")), len(y.split(" "))) < 5 or min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
            return False
        if len(x) > 100_000:
            return x[: len(y)] == y[: len(x)]
        return duckdb.execute("SELECT levenshtein(?, ?)", [x, y]).fetchone()[0] <= 0.2 * max(len(x), len(y))

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if find(a) != find(b) and alike(a, b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    want = Counter(k[0] for k in keys if find(k) != k)
    got = line_dedup.line_report(frame).collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == dict(want) and len(got) == len(texts)
    kept = line_dedup.dedup_lines(frame)
    assert kept.columns == frame.columns
    gone = {r.doc_id for r in got} - {r.doc_id for r in kept.collect()}
    assert gone == {*range(1, 40), 44, 46}
    assert line_dedup.dedup_lines(frame.filter("doc_id < 0")).count() == 0


def test_wand_equals_scoring_everything():
    rng = random.Random(1)
    items = [(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(12)), "yes it is so now") for _ in range(60)]
    index = decontamination.Index(items, block=4)
    for _ in range(100):
        terms = np.unique(rng.sample(range(len(index.terms)), rng.randint(1, len(index.terms))))
        score = np.zeros(index.n)
        for t in terms:
            score[index.item[index.at[t] : index.at[t + 1]]] += index.impact[index.at[t] : index.at[t + 1]]
        low = rng.choice([0.1, 0.3, 0.6])
        assert [i for i, _ in index.wand(terms, low)] == [i for i in range(index.n) if score[i] >= low - 1e-9]


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(800)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [f"{sentence(20)}? {sentence(8)}." for _ in range(30)] + ["", None, "two words"]
    texts = [f"{sentence(rng.randint(0, 150))} {items[i % 30].upper() if i % 2 else items[i % 30]} {sentence(rng.randint(0, 150))}" for i in range(40)]
    texts += [sentence(200) for _ in range(40)] + [items[0].split("?")[0], None, "", texts[0], sentence(30_000) + " " + items[3]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for shard in (8_000_000, 1500):
        got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, texts), bench, shard_chars=shard).collect()}
        assert got == {(i, i % 30) for i in range(40)} | {(83, 0), (84, 3)}
    assert decontamination.decontaminate(docs(spark, texts), bench).count() == len(texts) - 42
    assert decontamination.contaminated(docs(spark, texts), bench.filter("item_id < 0")).count() == 0


def test_mixing(spark):
    rng = random.Random(3)
    sources = [rng.choice(["a", "b", "c", "d", None]) if i > 150 else "a" for i in range(400)]
    texts = ["x " * rng.randint(0, 30) for _ in range(398)] + [None, "y " * 9000]
    frame = docs(spark, texts, sources)
    got = mixing.mix(frame, rows_per_range=20).collect()
    again = mixing.mix(frame.repartition(7), rows_per_range=20).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in again) and len(got) == 400
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert r["size"] == len((texts[r.doc_id] or "").split()) and r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        s = by.setdefault(sources[r.doc_id], [0, 0, r.target, r.source_size])
        s[0] += r["size"]
        s[1] += r.taken
    assert all(s[0] == s[3] and s[2] <= 3 * s[0] + 1e-6 for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(total)
    assert all(abs(s[1] - s[2]) <= max(r["size"] for r in got) for s in by.values())
    assert mixing.mix(frame.filter("doc_id < 0")).count() == 0
    kept = mixing.mix(frame, keep=True)
    assert {"doc_id", "text", "node", "taken"} <= set(kept.columns)


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    rng = random.Random(1)
    payloads = [bytes(rng.choice(b"abWARC/1.\r\n\x1f\x8b\x08") for _ in range(rng.randint(0, 2000))) for _ in range(30)]
    records = [warc.record("response", str(i), "http://x/é", p) for i, p in enumerate(payloads)]
    records = [warc.member(r) if packed else r for r in records]
    data, edges = b"".join(records), np.cumsum([0, *map(len, records)])
    assert [r["payload"] for r in warc.salvage(Source(data))] == payloads
    for _ in range(25):
        bad, hurt = set(rng.sample(range(30), 3)), bytearray(data)
        for b in bad:
            hurt[rng.randrange(edges[b], edges[b + 1] - 4)] ^= 0x55
        got = list(warc.salvage(Source(bytes(hurt))))
        assert {payloads[i] for i in range(30) if i not in bad} <= {r["payload"] for r in got if r["kind"] != "gap"}
        assert sum(r["end"] - r["at"] for r in got) == len(data) and any(r["kind"] == "gap" for r in got)
    cut = list(warc.salvage(Source(data[: edges[20] + 5])))
    assert len(cut) == 21 and cut[-1]["kind"] == "gap"


def test_salvage_mixed_files():
    """Several records a member, version lines between members, damage inside a member: positions part the file."""
    rng = random.Random(5)
    payloads = [bytes(rng.choice(b"abc\r\n\x1f\x8b") for _ in range(rng.randint(0, 3000))) for _ in range(10)]
    r = [warc.record("response", str(i), "http://x", p) for i, p in enumerate(payloads)]
    hurt, torn = bytearray(r[1]), bytearray(warc.member(r[0]))
    hurt[-10] ^= 1
    torn[30] ^= 0x55
    cases = [
        (warc.member(r[0] + r[1] + r[2]) + r[3] + warc.member(r[4]) + r[5] + r[6] + warc.member(r[7] + r[8]), list(range(9))),
        (warc.member(r[9]) + bytes(torn) + r[3] + warc.member(r[4]), [9, 3, 4]),
        (warc.member(r[0] + bytes(hurt) + r[2]) + warc.member(r[4]), [0, 2, 4]),
        (warc.member(r[3] * 2000)[:-9], [3] * 1999),
        (warc.member(b"") + r[2], [2]),
        (b"", []),
        (b"junk", []),
    ]
    for data, kept in cases:
        got = list(warc.salvage(Source(data)))
        assert [x["payload"] for x in got if x["kind"] != "gap"] == [payloads[i] for i in kept]
        assert [x["at"] for x in got] == [0, *(x["end"] for x in got[:-1])][: len(got)] and (not got or got[-1]["end"] == len(data))


def test_archives(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "u", "same"), (2, "v", None), (5, "w", ""), (None, "n", "same"), (7, "x", "é" * 50_000), (1, "u", "same"), (9, None, "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, spark).collect()), key=str)
    assert got == sorted(
        [(3, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "response", None), (2, 0, "response", None), (5, 0, "revisit", 2), (None, 4, "revisit", 1), (7, 100_000, "response", None), (9, 3, "response", None)], key=str
    )
    assert {r.record_type for r in warc.round_trip(pages, spark, least=5).collect()} == {"response"}
    assert warc.round_trip(pages.filter("page_id > 100"), spark).count() == 0
    files = warc.write_archives(warc.with_responses(pages), f"file://{tmp_path}/w", roll=300, packed=False)
    assert warc.read_archives(files.cache()).filter("kind = 'response'").count() == 5 and files.count() > 1
