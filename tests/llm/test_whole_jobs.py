"""Operators with production parameters over all of their data."""

import inspect
import random

import numpy as np
import pyarrow as pa

from plumbline.llm import language_ppm, logbilinear, near_duplicates


def test_network_trains_on_every_position(spark):
    how = {k: p.default for k, p in inspect.signature(logbilinear.score).parameters.items()}
    at = np.array([0, 1, 2, 2, 9, 30, 33])
    got = np.concatenate([logbilinear.picked(at, turn, how["stride"]) for turn in range(how["rounds"])])
    assert set(got.tolist()) == set(range(33))
    rng = random.Random(6)
    texts = []
    for _ in range(400):
        w, t = rng.randrange(30), []
        for _ in range(60):
            t.append(f"w{w}")
            w = (w * 7 + 3 + rng.randrange(2)) % 30
        texts.append(" ".join(t))
    out = logbilinear.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("held_out").collect()
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_every_language_is_learned(spark):
    """More languages than the hundred that once had a model; the rare ones count as the frequent ones."""
    rng = random.Random(8)
    rows = []
    for k in range(130):
        letters = [chr(0x4E00 + 10 * k + j) for j in range(8)]
        for _ in range(6 if k < 100 else 5):
            rows.append((len(rows), "".join(rng.choice(letters) for _ in range(80)), f"lang{k}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_ppm.train(frame)
    assert len(model.langs) == 130 and len(model.groups) > 1
    got = {r.doc_id: r.lang_pred for r in language_ppm.identify(frame, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_joined_texts_have_wide_offsets():
    pieces = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"text {i}"])], ["node", "text"]) for i in range(3)]
    whole = near_duplicates._join(pieces)
    assert whole.column(1).type == pa.large_string() and whole.column(1).to_pylist() == ["text 0", "text 1", "text 2"]
