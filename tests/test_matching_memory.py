"""Joins and capped matching in tiles of bounded size."""

import numpy as np

from plumbline.functions import metrics
from plumbline.operators import matching

from .test_search_memory import frame, spy  # noqa: F401


def test_knn_join_in_tiles(spark, spy):  # noqa: F811
    x = np.random.default_rng(2).normal(size=(2400, 3))
    rows = frame(spark, x).coalesce(1)
    bounded = lambda a, b: spy("l2sq", a, b)
    even, odd = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    d = np.round(metrics.matrix("l2sq", x[::2], x[1::2]), 6)
    want = np.argsort(d, axis=1, kind="stable")[:, :2]
    got = {(r.l, r["rank"]): r.r for r in matching.knn_join(even, odd, 2, bounded).collect()}
    assert got == {(2 * i, k + 1): int(2 * want[i, k] + 1) for i in range(1200) for k in range(2)}


def test_capped_match_in_tiles(spark, spy):  # noqa: F811
    """Against deferred acceptance over lists of ln(n) + 1, one proposal at a time."""
    x = np.random.default_rng(4).normal(size=(2400, 3))
    rows = frame(spark, x).coalesce(1)
    got = {(r.l, r.r) for r in matching.match(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), lambda a, b: spy("l2sq", a, b)).collect()}
    d = np.round(metrics.matrix("l2sq", x[::2], x[1::2]), 6)
    lists = np.argsort(d, axis=1, kind="stable")[:, : matching.default_proposals(1200)]
    held, todo, at = {}, list(range(1200)), [0] * 1200
    while todo:
        i = todo.pop()
        if at[i] < lists.shape[1]:
            j = int(lists[i, at[i]])
            at[i] += 1
            if j not in held or (d[i, j], i) < (d[held[j], j], held[j]):
                i, held[j] = held.get(j), i
            if i is not None:
                todo.append(i)
    assert got == {(2 * i, 2 * j + 1) for j, i in held.items()}
