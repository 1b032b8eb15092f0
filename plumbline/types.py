"""Metric and scalar kinds, schemas, configuration and validation."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

#: Metric names with their aliases. Fixed values.
METRICS = {
    "ip": ("ip", "inner", "dot"),
    "cos": ("cos", "angular"),
    "l2sq": ("l2sq", "euclidean_sq"),
    "pearson": ("pearson",),
    "haversine": ("haversine",),
    "divergence": ("divergence",),
    "hamming": ("hamming",),
    "tanimoto": ("tanimoto",),
    "sorensen": ("sorensen",),
    "jaccard": ("jaccard",),
}

#: Scalar kinds: name -> bits. Fixed values.
SCALAR_BITS = {
    "f64": 64, "f32": 32, "f16": 16, "bf16": 16, "e5m2": 8, "e4m3": 8, "e3m2": 8, "e2m3": 8, "i8": 8, "u8": 8, "b1": 1,
    "u64": 64, "u32": 32, "u16": 16, "i64": 64, "i32": 32, "i16": 16, "u40": 40, "uuid": 128,
}

#: Ids are BIGINT; the largest unsigned id marks tombstones elsewhere, so negative ids are refused.
MAX_ID = (1 << 63) - 1


def metric_kind(name: str) -> str:
    """Canonical metric name; ValueError for an unknown one."""
    for kind, names in METRICS.items():
        if name in names:
            return kind
    raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(n for v in METRICS.values() for n in v))}")


def scalar_kind(name: str) -> str:
    if name in ("b1x8", "b1"):
        return "b1"
    if name not in SCALAR_BITS:
        raise ValueError(f"unknown scalar kind {name!r}")
    return name


def bits_per_scalar(name: str) -> int:
    return SCALAR_BITS[scalar_kind(name)]


def bits_per_word(name: str) -> int:
    """Bits of the smallest addressable unit: single bits are packed by eight."""
    return max(8, bits_per_scalar(name))


def check_id(value: int) -> int:
    if not 0 <= value <= MAX_ID:
        raise ValueError(f"id {value} is outside 0 .. 2**63 - 1")
    return value


@dataclass
class Config:
    """Collection and maintenance settings, read from the sections of a TOML file."""

    dim: int = 0
    metric: str = "ip"
    data_type: str = "f32"
    initial_capacity: int = 100_000
    connectivity: int = 16
    expansion_add: int = 128
    expansion_search: int = 64
    snapshot_threshold: int = 10_000
    batch_max_entries: int = 64
    pipeline_window_size: int = 16
    check_interval_s: int = 60
    compact_delete_ratio_threshold: float = 0.2
    compact_max_interval_s: int = 604_800
    isolate_fragmentation_threshold: float = 0.1
    dedup_window_size: int = 1000
    retry_base_ms: int = 50
    retry_max_ms: int = 2000
    max_retry_count: int = 10
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        self.metric = metric_kind(self.metric)
        self.data_type = scalar_kind(self.data_type)
        if self.dim <= 0:
            raise ValueError("vector.dim must be positive")
        for name in ("initial_capacity", "expansion_add", "expansion_search", "batch_max_entries", "check_interval_s", "compact_max_interval_s", "dedup_window_size", "retry_base_ms"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.connectivity < 2:
            raise ValueError("connectivity must be at least 2")
        for name in ("compact_delete_ratio_threshold", "isolate_fragmentation_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.retry_base_ms > self.retry_max_ms:
            raise ValueError("retry_base_ms exceeds retry_max_ms")

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """Unknown keys are kept in ``extra``. dimension and scalar_kind are accepted for dim and data_type."""
        known = {f.name for f in fields(cls)} - {"extra"}
        alias = {"dimension": "dim", "scalar_kind": "data_type"}
        out, extra = {}, {}
        for section, values in tomllib.loads(text).items():
            for key, value in values.items() if isinstance(values, dict) else [(section, values)]:
                key = alias.get(key, key)
                if key in known:
                    out[key] = value
                else:
                    extra[f"{section}.{key}"] = value
        return cls(**out, extra=extra)
