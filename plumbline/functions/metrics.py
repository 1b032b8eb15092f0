"""Distances between vectors: Column expressions, and the same kernels on numpy matrices.

Smaller is closer. Vectors are array<double> columns (bits: array<boolean> or packed array<bigint>). The integer
kinds (i8, u8) keep two peculiarities of quantised kernels: a zero dot product has cosine
distance 0, and the inner product is not scaled back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import metric_kind

#: Machine epsilon of float32, the smoothing term of the divergence. Fixed value.
EPS = 1.1920928955078125e-07


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _zip(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, f))


def dot(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def inner_product(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def cosine(a: Column, b: Column, integer: bool = False) -> Column:
    ab, aa, bb = dot(a, b), dot(a, a), dot(b, b)
    if integer:
        return F.when(ab != 0, 1 - ab / (F.sqrt(aa) * F.sqrt(bb))).otherwise(F.lit(0.0))
    return F.when((aa == 0) & (bb == 0), F.lit(0.0)).when((aa == 0) | (bb == 0), F.lit(1.0)).otherwise(1 - ab / (F.sqrt(aa) * F.sqrt(bb)))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: (x - y) * (x - y))


def pearson(a: Column, b: Column) -> Column:
    n, sa, sb = F.size(a).cast("double"), _sum(a), _sum(b)
    den = (n * dot(a, a) - sa * sa) * (n * dot(b, b) - sb * sb)
    return F.when((n <= 1) | (den <= 0), F.lit(0.0)).otherwise(1 - (n * dot(a, b) - sa * sb) / F.sqrt(den))


def haversine(a: Column, b: Column) -> Column:
    """[latitude, longitude] in degrees; radians on the unit sphere."""
    p, q = F.radians(a[0]), F.radians(b[0])
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b[1] - a[1]) / 2), 2)
    return 2 * F.asin(F.sqrt(h))


def divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon, natural log, not rooted."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2 + EPS
        return x * F.ln((x + EPS) / m) + y * F.ln((y + EPS) / m)

    return _zip(a, b, term) / 2


def _counts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    count = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("bigint"), lambda s, x: s + x)
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    return count(lambda x, y: one(x & y)), count(lambda x, y: one(x | y)), count(lambda x, y: one(x != y))


def hamming(a: Column, b: Column) -> Column:
    return _counts(a, b)[2].cast("double")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(float("nan"))).otherwise(1 - num.cast("double") / F.nullif(den, F.lit(0)))


def tanimoto(a: Column, b: Column) -> Column:
    both, any_, _ = _counts(a, b)
    return _ratio(both, any_)


def sorensen(a: Column, b: Column) -> Column:
    both, any_, _ = _counts(a, b)
    return _ratio(2 * both, both + any_)


def packed_hamming(a: Column, b: Column) -> Column:
    """On bits packed into bigints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("double")


def jaccard_sets(a: Column, b: Column) -> Column:
    """Sets of integers of any sizes; two empty sets give NaN."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


EXPRESSIONS = {
    "ip": inner_product, "cos": cosine, "l2sq": squared_euclidean, "pearson": pearson, "haversine": haversine, "divergence": divergence,
    "hamming": hamming, "tanimoto": tanimoto, "sorensen": sorensen, "jaccard": tanimoto,
}


def distance(metric, a: Column, b: Column, kind: str = "f32") -> Column:
    """metric: a name, or a function of two Columns (user-defined metric)."""
    if callable(metric):
        return metric(a, b)
    name = metric_kind(metric)
    if name == "cos" and kind in ("i8", "u8"):
        return cosine(a, b, integer=True)
    return EXPRESSIONS[name](a, b)


def matrix(metric, x: np.ndarray, y: np.ndarray, kind: str = "f32") -> np.ndarray:
    """All distances between the rows of x and of y, in double precision. metric: a name or a function of two matrices."""
    if callable(metric):
        return np.asarray(metric(x, y), np.float64)
    name = metric_kind(metric)
    x, y = x.astype(np.float64), y.astype(np.float64)
    if name in ("hamming", "tanimoto", "sorensen", "jaccard"):
        a, b = (x > 0).astype(np.float64), (y > 0).astype(np.float64)
        both, na, nb = a @ b.T, a.sum(1)[:, None], b.sum(1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"hamming": lambda: na + nb - 2 * both, "sorensen": lambda: 1 - 2 * both / (na + nb)}.get(name, lambda: 1 - both / (na + nb - both))()
    if name == "haversine":
        p, q = np.radians(x[:, None, 0]), np.radians(y[None, :, 0])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(y[None, :, 1] - x[:, None, 1]) / 2) ** 2
        return 2 * np.arcsin(np.sqrt(h))
    if name == "divergence":
        out = np.empty((len(x), len(y)))
        for i, row in enumerate(x):  # one row at a time keeps the temporary at the size of y
            m = (row + y) / 2 + EPS
            out[i] = (row * np.log((row + EPS) / m) + y * np.log((y + EPS) / m)).sum(1) / 2
        return out
    ab = x @ y.T
    if name == "ip":
        return 1 - ab
    aa, bb = (x * x).sum(1)[:, None], (y * y).sum(1)[None, :]
    if name == "l2sq":
        return np.maximum(aa + bb - 2 * ab, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        if name == "cos":
            d = 1 - ab / (np.sqrt(aa) * np.sqrt(bb))
            if kind in ("i8", "u8"):
                return np.where(ab != 0, d, 0.0)
            return np.where((aa == 0) & (bb == 0), 0.0, np.where((aa == 0) | (bb == 0), 1.0, d))
        n, sa, sb = x.shape[1], x.sum(1)[:, None], y.sum(1)[None, :]
        den = (n * aa - sa * sa) * (n * bb - sb * sb)
        return np.where((den <= 0) | (n <= 1), 0.0, 1 - (n * ab - sa * sb) / np.sqrt(np.where(den > 0, den, 1)))
