"""Hand-computed edges of the distances, and agreement of Column and matrix kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import metrics, quantize
from plumbline.types import METRICS, Config, bits_per_scalar, bits_per_word, check_id, metric_kind, scalar_kind

CASES = [
    ("cos", [0.0, 0.0], [1.0, 2.0], 1.0),
    ("cos", [0.0, 0.0], [0.0, 0.0], 0.0),
    ("ip", [2.0, 0.0], [3.0, 0.0], -5.0),
    ("l2sq", [1.0, 2.0], [3.0, 5.0], 13.0),
    ("pearson", [1.0], [2.0], 0.0),
    ("pearson", [1.0, 1.0], [2.0, 3.0], 0.0),
    ("pearson", [1.0, 2.0, 3.0], [3.0, 2.0, 1.0], 2.0),
    ("haversine", [0.0, 0.0], [0.0, 90.0], math.pi / 2),
    ("divergence", [0.5, 0.5], [0.5, 0.5], 0.0),
]
BITS = [("hamming", 2.0), ("tanimoto", 2 / 3), ("sorensen", 0.5)]


def column(spark, a, b, f):
    return spark.range(1).select(f(F.lit(a), F.lit(b)).alias("d")).first().d


@pytest.mark.parametrize("name,a,b,want", CASES)
def test_fixed_values(spark, name, a, b, want):
    array = lambda v: F.array(*[F.lit(x) for x in v])
    got = spark.range(1).select(metrics.distance(name, array(a), array(b)).alias("d")).first().d
    assert got == pytest.approx(want, abs=1e-6)
    assert metrics.matrix(name, np.array([a]), np.array([b]))[0, 0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("name,want", BITS)
def test_bits(spark, name, want):
    a, b, none = [True, True, False, False], [True, False, True, False], [False] * 4
    array = lambda v: F.array(*[F.lit(x) for x in v])
    row = spark.range(1).select(metrics.distance(name, array(a), array(b)).alias("d"), metrics.distance(name, array(none), array(none)).alias("e")).first()
    assert row.d == pytest.approx(want)
    assert row.e == 0.0 if name == "hamming" else math.isnan(row.e)
    assert metrics.matrix(name, np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(want)


def test_integer_cosine_and_jaccard(spark):
    array = lambda v: F.array(*[F.lit(x) for x in v])
    row = spark.range(1).select(
        metrics.distance("cos", array([127.0, 0.0]), array([0.0, 127.0]), "i8").alias("q"),
        metrics.jaccard_sets(array([1, 2, 3]), array([2, 3, 4])).alias("j"),
    ).first()
    assert row.q == 0.0 and row.j == pytest.approx(0.5)


@pytest.mark.parametrize("name", ["ip", "cos", "l2sq", "pearson", "divergence"])
def test_both_plans_agree_and_are_symmetric(spark, name):
    x = np.abs(np.random.default_rng(1).normal(size=(6, 8)))
    m = metrics.matrix(name, x, x)
    assert np.allclose(m, m.T)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "id long, v array<double>")
    got = df.crossJoin(df.select(F.col("id").alias("j"), F.col("v").alias("w"))).select("id", "j", metrics.distance(name, F.col("v"), F.col("w")).alias("d")).collect()
    assert all(abs(m[r.id, r.j] - r.d) < 1e-9 for r in got)


def test_names():
    assert {metric_kind(a) for v in METRICS.values() for a in v} == set(METRICS)
    with pytest.raises(ValueError):
        metric_kind("nope")
    assert scalar_kind("b1x8") == "b1" and bits_per_scalar("bf16") == 16 and bits_per_word("b1") == 8
    with pytest.raises(ValueError):
        check_id(-1)


def test_quantisers(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    z = F.array(F.lit(0.0), F.lit(0.0))
    bits = quantize.binarize(F.array(F.lit(0.1), F.lit(0.0), F.lit(-1.0)))
    row = spark.range(1).select(quantize.quantize_i8(v).alias("a"), quantize.quantize_i8(z).alias("z"), quantize.unbinarize(bits).alias("b"), quantize.pack_bits(bits).alias("p")).first()
    assert list(row.a) == [76, 101] and list(row.z) == [0, 0] and list(row.b) == [1.0, 0.0, 0.0] and list(row.p) == [1 << 31]


def test_small_floats():
    r = lambda x, k: quantize.round_trip(np.array([x], np.float32), k)[0]
    assert r(1.0, "e4m3") == 1.0 and r(1000.0, "e4m3") == 448.0 and r(1e6, "e5m2") == np.inf
    assert r(100.0, "e2m3") == 7.5 and r(0.05, "e2m3") == 0.0 and r(100.0, "e3m2") == 28.0 and r(0.02, "e3m2") == 0.0
    assert r(1.00390625, "bf16") == 1.0 and r(65520.0, "f16") == np.inf
    for kind in ("f16", "bf16", "e5m2", "e4m3", "e3m2", "e2m3"):
        x = quantize.round_trip(np.linspace(-4, 4, 101), kind)
        assert np.array_equal(quantize.round_trip(x, kind), x)  # what is stored comes back unchanged


def test_config():
    c = Config.from_toml('[vector]\ndimension = 8\nmetric = "cos"\n[client]\ndedup_window_size = 5\n[server]\ngrpc_port = 1\n')
    assert (c.dim, c.metric, c.dedup_window_size, c.extra) == (8, "cos", 5, {"server.grpc_port": 1})
    for bad in ("[vector]\ndim = 0\n", '[vector]\ndim = 4\nmetric = "x"\n', "[vector]\ndim = 4\nconnectivity = 1\n"):
        with pytest.raises(ValueError):
            Config.from_toml(bad)
