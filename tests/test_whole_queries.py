"""Queries over whole tables against brute force."""

import numpy as np

from plumbline.plans import vector_queries as v


def table(spark, sf):
    rows = sorted(v.scaled(spark, sf).collect(), key=lambda r: r.id)
    return np.array([r.id for r in rows]), np.array([r.vec for r in rows]), np.array([r.label for r in rows])


def test_greedy_match_whole(spark, sf):
    ids, vec, _ = table(spark, sf)
    d = np.round(1 - vec @ vec.T, 6)
    pairs = sorted((d[i, j], int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 2 == 0) for j in np.flatnonzero(ids % 2 == 1))
    left, right, want = set(), set(), set()
    for _, a, b in pairs:
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    got = v.greedy_match_whole(spark, sf).collect()
    assert len(got) == min((ids % 2 == 0).sum(), (ids % 2 == 1).sum()) > 40
    assert {(r.l, r.r) for r in got} == want


def test_searches_take_the_fixed_queries(spark, sf):
    ids, vec, label = table(spark, sf)
    fixed = ids[ids % 50 == 0]
    d = np.round(1 - vec @ vec.T, 6)
    got = v.QUERIES["ip_top5_whole"](spark, sf).collect()
    assert {(r.qid, r.rank, r.id) for r in got} == {(int(q), k + 1, int(ids[j])) for q in fixed for k, j in enumerate(np.lexsort((ids, d[ids == q][0]))[:5])}
    for name in ("tanimoto_sign_whole", "sorensen_sign_whole", "cos_u8_whole", "l2sq_u8_whole"):
        assert {r.qid for r in v.QUERIES[name](spark, sf).collect()} == set(fixed.tolist())


def test_padded_whole(spark, sf):
    ids, _, label = table(spark, sf)
    n = int((label == 3).sum())
    got = v.search_padded_whole(spark, sf).collect()
    fixed = set(ids[ids % 50 == 0].tolist())
    assert {r.qid for r in got} == fixed and len(got) == len(fixed) * (n + 10)
    assert {r.id for r in got if r["rank"] <= n} == set(ids[label == 3].tolist()) and all(r.id == 0 for r in got if r["rank"] > n)
