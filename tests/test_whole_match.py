"""Whole matching by lists of bounded width."""

import numpy as np

from plumbline.operators import matching


def greedy(a, b, ids_a, ids_b):
    pairs = sorted((round(float(((x - y) ** 2).sum()), 6), i, j) for x, i in zip(a, ids_a, strict=True) for y, j in zip(b, ids_b, strict=True))
    left, right, out = set(), set(), set()
    for _, i, j in pairs:
        if i not in left and j not in right:
            left.add(i), right.add(j), out.add((i, j))
    return out


def test_lists_stay_short(spark, monkeypatch):
    """Many ties and uneven sides: lists run out and are made anew, but never hold all pairs."""
    widths, join = [], matching.knn_join
    monkeypatch.setattr(matching, "knn_join", lambda a, b, k, *more, **kw: widths.append(k) or join(a, b, k, *more, **kw))
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 4, size=(37, 2)).astype(float), rng.integers(0, 4, size=(53, 2)).astype(float)
    left, right = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(1) for x in (a, b))
    got = {(r.l, r.r) for r in matching.match(left, right, "l2sq", proposals=0).collect()}
    assert got == greedy(a, b, range(37), range(53))
    assert max(widths) <= 16


def test_empty_side(spark):
    some = spark.createDataFrame([(1, [0.0])], "id long, vec array<double>")
    assert matching.match(some, some.filter("id > 1"), "l2sq", proposals=0).collect() == []
