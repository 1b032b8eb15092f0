"""Text primitives, token counts, language models and the media format against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import avi, jpeg, language_ppm, logbilinear, textbytes
from plumbline.llm.token_counts import _Counter, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, h long"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else None, "s", 0, "x", 1) for i, t in enumerate(texts)], DOCS)


def words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]


def test_words_and_shingles():
    rng = random.Random(1)
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab É\n\t\x00Z") for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(1, 5))]
        w = textbytes.Words(pa.array(texts, pa.string()))
        assert w.count.tolist() == [len(words(t)) for t in texts]
        flat = [x for t in texts for x in words(t)]
        assert len(set(flat)) == len(set(w.hashes().tolist()))
        _, at = textbytes.shingles(w, 3)
        for i, t in enumerate(texts):
            e = words(t)
            want = {tuple(e[j : j + 3]) for j in range(len(e) - 2)} if len(e) >= 3 else {tuple(e)} if e else set()
            assert at[i + 1] - at[i] == len(want)


def test_token_counts(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \n\t.,'s t1290é<|你\x85 It's don't  x") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    texts += [None, "", "<|endoftext|>", "x<|endoftext|>y", "word " * 1500, texts[0]]
    got = {r.doc_id: r for r in token_counts(docs(spark, texts)).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 1024)
    assert token_counts(docs(spark, texts).filter("doc_id < 0")).count() == 0
    small = _Counter("byte_bpe_50k.json", {}, 3)  # a cache that overflows all the time
    assert [small.count(x or "") for x in texts] == [got[i].n_tokens for i in range(len(texts))]


def brute_code(texts, text):
    fold = lambda b: bytes(language_ppm.FOLD[np.frombuffer(b"\n\n\n" + b, np.uint8)])
    count = [defaultdict(Counter) for _ in range(4)]
    for x in map(fold, texts):
        for i in range(3, len(x)):
            for k in range(4):
                count[k][x[i - k : i]][x[i]] += 1

    def p(ctx, s):
        low = (lambda: p(ctx[1:], s)) if ctx else (lambda: 1 / 256)
        c = count[len(ctx)].get(ctx)
        if not c:
            return low()
        n, d = sum(c.values()), len(c)
        return c[s] / (n + d) if s in c else d / (n + d) * low()

    x = fold(text)
    return sum(-math.log2(p(x[i - 3 : i], x[i])) for i in range(3, len(x)))


def test_ppm_code_lengths():
    rng = random.Random(3)
    texts = {"a": [bytes(rng.choice(b"abcAB1 ") for _ in range(60)) for _ in range(3)], "b": [bytes(rng.choice(b"bcd\xc3\xa9 ") for _ in range(40)) for _ in range(2)]}
    model = language_ppm.Model(texts)
    samples = ["abc 12 ABBA", "", "bcdé d zzz", "qqqq"]
    got = model.lengths(pa.array(samples))
    for i, s in enumerate(samples):
        for j, lang in enumerate("ab"):
            assert got[i, j] == pytest.approx(brute_code(texts[lang], s.encode()), rel=1e-4, abs=1e-3)


def test_language_edges_and_accuracy(spark, sf):
    rng = random.Random(4)
    make = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(30))
    texts = [make("abcde") if i % 2 else make("vwxyz") for i in range(60)] + [None, "", "123 !!", texts_long := "abcde " * 30_000, texts_long]
    frame = docs(spark, texts, ["ab" if i % 2 else "vw" for i in range(60)] + [None] * 5)
    got = {r.doc_id: r for r in language_ppm.identify(frame, language_ppm.train(frame)).collect()}
    assert all(got[i].lang_pred == ("ab" if i % 2 else "vw") and 0.5 < got[i].score <= 1 for i in range(60))
    assert [got[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and got[60].score == 0 and got[63].lang_pred == got[64].lang_pred == "ab"
    none = frame.filter("lang is null")
    assert {r.lang_pred for r in language_ppm.identify(none, language_ppm.train(none)).collect()} == {"und"}
    assert language_ppm.reject_unknown(frame).count() == 62 and language_ppm.reject_unknown(frame).columns == frame.columns
    real = spark.read.parquet(f"{sf}/documents.parquet")
    both = language_ppm.identify(real, language_ppm.train(real)).join(real, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.95 * len(both)


def test_log_bilinear(spark):
    rng = random.Random(5)
    frequent = [f"w{i}" for i in range(30)]
    texts = []
    for i in range(300):
        at, t = rng.randrange(30), []
        for _ in range(60):
            t.append(frequent[at] if rng.random() < 0.95 else f"Rare{rng.randrange(500)}")
            at = (at * 7 + 3 + rng.randrange(2)) % 30
        texts.append(" ".join(t))
    texts += [None, "", "never seen at all", texts[0]]
    for table_size in (100_000, 20):  # with and without words that need the join
        got = {r.doc_id: r for r in logbilinear.score(docs(spark, texts), table_size=table_size, stride=2, rounds=3).collect()}
        tokens = {i: [*words(t), None] for i, t in enumerate(texts)}
        held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
        c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
        n, v = sum(c.values()), len(c)
        for i, t in tokens.items():
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        out = [got[i] for i in range(300) if held[i]]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert logbilinear.score(docs(spark, texts).filter("doc_id < 0")).count() == 0


def test_network_is_normalised():
    net = logbilinear.Network(np.full(logbilinear.CLASSES, 1 / logbilinear.CLASSES))
    every = np.arange(logbilinear.CLASSES)
    for a, b in ((0, 0), (5, 1000), (1023, 17)):
        assert np.exp(net.log_prob(np.full_like(every, a), np.full_like(every, b), every)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_by_hand(spark, monkeypatch):
    """score is the sum of log10 P(class | classes before) * (c + 0.1) / mass of the class, from the trained parameters alone."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5 + 40 * i)}" for _ in range(25)) for i in range(60)] + ["", None, "never Seen w1 w1"]
    nets, train = [], logbilinear.train
    monkeypatch.setattr(logbilinear, "train", lambda *a, **k: nets.append((train(*a, **k), a[1])) or nets[-1][0])
    got = {r.doc_id: r for r in logbilinear.score(docs(spark, texts), table_size=50).collect()}
    (net, v), k = nets[0], logbilinear.CLASSES
    r, q, bias, near, far = (p.astype(np.float64) for p in net.parts)
    c = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in [*words(t), None])
    (h, _, _), singles = logbilinear._tokens(pa.array([" ".join(sorted(w.decode() for w in c if w))])), v.single.tolist()
    single = dict(zip(sorted(w for w in c if w), h.tolist(), strict=False))

    def cls(w):
        x = int(logbilinear.END) if w is None else single.get(w)
        if x in singles:
            return singles.index(x)
        return logbilinear.SINGLES + (w[-1] * 131 + w[max(len(w) - 2, 0)] * 31) % 9973 % logbilinear.TAILS

    members = defaultdict(float)
    for w, n in c.items():
        members[cls(w)] += n + 0.1
    unseen = 0.1 / logbilinear.TAILS  # the unknown word is spread over the tail classes
    for i, t in enumerate(texts):
        total, a, b = 0.0, cls(None), cls(None)
        for w in [*words(t), None]:
            s = (r[a] @ near + r[b] @ far) @ q.T + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            if w in c:
                mass = members[cls(w)] + (unseen if cls(w) >= logbilinear.SINGLES else 0)
                total += math.log10(p[cls(w)] * (c[w] + 0.1) / mass)
            else:
                total += math.log10(sum(p[x] * unseen / (members[x] + unseen) for x in range(logbilinear.SINGLES, k)))
            a, b = cls(w), a
        assert got[i].score == pytest.approx(total, rel=1e-3, abs=1e-2)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 20_000])
def test_media_round_trip(n):
    rng = random.Random(n)
    data = bytes(rng.choice([255, 0, 128, 127, rng.randrange(256)]) for _ in range(n))
    media = avi.store_bytes(np.frombuffer(data, np.uint8))
    video, coefs, samples = avi.decode(media)
    size = max(64, -(-n // 64) * 64)
    assert jpeg.stored(coefs).ravel()[:size].tobytes() == data + bytes(size - n)
    assert (jpeg._walk(jpeg.parse(video["frames"][0]), coefs.shape[1]) == coefs[0]).all()
    plain = avi.read_avi(media.replace(b"idx1", b"JUNK"))  # without its index the file is walked
    assert plain["frames"] == video["frames"]


def test_shots_and_damage():
    dark, light = np.full((6, 4, 64), 20, np.uint8), np.full((5, 4, 64), 200, np.uint8)
    assert avi.shots(np.concatenate([dark, light, dark]))[0] == [0, 6, 11]
    assert avi.shots(np.zeros((0, 1, 64), np.uint8))[0] == []
    for bad in (b"", b"RIFF0000WAVE"):
        with pytest.raises(ValueError):
            avi.read_avi(bad)
    frame = avi.read_avi(avi.store_bytes(np.arange(200, dtype=np.uint8)))["frames"][0]
    with pytest.raises(ValueError):
        jpeg.coefficients(frame[:-40] + frame[-2:])


def test_media_features(spark):
    texts = [None, "", "a", "a" * 9000, "é" * 40, "a"]
    got = {r.doc_id: r for r in avi.features(avi.store(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2].media_sha256 == got[5].media_sha256 and got[2].feature == got[5].feature
    shown = avi.clips(avi.store(docs(spark, texts))).collect()
    assert {r.doc_id for r in shown} == set(range(6)) and all(r.end_s > r.start_s for r in shown)
    for i in got:
        assert [(c.start_s, c.end_s) for c in got[i].clips] == [(r.start_s, r.end_s) for r in sorted(shown, key=lambda r: r.clip) if r.doc_id == i]
    null_id = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert [r.doc_id for r in avi.features(avi.store(null_id)).collect()] == [None]
    assert avi.features(avi.store(null_id.filter("text = 'no'"))).count() == 0
