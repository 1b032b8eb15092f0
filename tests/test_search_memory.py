"""The matrix plan holds tiles of bounded size, however many queries there are."""

import numpy as np
import pytest

from plumbline.functions import metrics
from plumbline.operators import search


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.fixture
def spy(monkeypatch):
    """The largest matrix of distances that a worker may make."""
    made = metrics.matrix

    def matrix(metric, x, y, kind="f32"):
        assert len(x) * len(y) <= 1 << 20, f"{len(x)} x {len(y)} distances at once"
        return made(metric, x, y, kind)

    return matrix


def test_tiles_are_bounded(spark, spy):
    x = np.random.default_rng(1).normal(size=(3000, 4))
    rows = frame(spark, x)
    bounded = lambda a, b: spy("l2sq", a, b)
    got = {(r.qid, r["rank"]): r.id for r in search.search(rows, rows, 3, bounded).collect()}
    d = np.round(metrics.matrix("l2sq", x, x), 6)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got == {(q, k + 1): int(want[q, k]) for q in range(3000) for k in range(3)}


def test_ties_nans_and_few_members(spark):
    """Equal distances go by id over tile borders, NaN comes last, and k may exceed the collection."""
    rows = spark.createDataFrame([(i, [float(i % 3)]) for i in range(9000, 0, -1)] + [(9001, [float("nan")])], "id long, vec array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    got = [r.id for r in search.search(rows, q, 3005, "l2sq").orderBy("rank").collect()]
    assert got == list(range(1, 9001, 3)) + [2, 3, 5, 6, 8]
    few = [r.id for r in search.search(rows.filter("id > 8998"), q, 9, "l2sq").orderBy("rank").collect()]
    assert few == [8999, 9000, 9001]
