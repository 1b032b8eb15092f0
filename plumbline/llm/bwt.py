"""Multi-string Burrows-Wheeler transforms and their merging by interleave refinement.

Strings are rows of m symbols each. A shard's transform lists the shard's suffixes (ends included) in order, with
the symbol before each. Two shards are merged without comparing suffixes: an interleave of their lists, at
first one after the other, is refined once per depth by a stable distribution over the symbols that precede its
entries; the depth at which two neighbours part is their common prefix, in symbols. After m refinements the
entries that are still together and are whole strings are equal strings.
"""

from __future__ import annotations

import numpy as np


class Transform:
    """order: suffix numbers string * (m + 1) + begin, sorted; before: the symbol before each, 0 for none."""

    def __init__(self, order: np.ndarray, before: np.ndarray, strings: int, lcp: np.ndarray):
        self.order, self.before, self.strings, self.lcp = order, before, strings, lcp


def build(symbols: np.ndarray) -> Transform:
    """Sort one shard's suffixes by prefix doubling; symbols (n, m) are at least 1."""
    n, m = symbols.shape
    rank = np.zeros((n, m + 1), np.int64)
    rank[:, :m] = symbols
    step = 1
    while step <= m:
        after = np.zeros_like(rank)
        after[:, :-step] = rank[:, step:] + 1 if step <= m else 0
        key = rank * (rank.max(initial=0) + after.max(initial=0) + 2) + after
        rank = np.unique(key, return_inverse=True)[1].reshape(n, m + 1)
        step *= 2
    order = np.argsort(rank.ravel(), kind="stable")
    return Transform(order, _before(symbols, order), n, np.zeros(0, np.int8))


def _before(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    m = symbols.shape[1]
    begin = order % (m + 1)
    before = symbols[order // (m + 1), np.maximum(begin - 1, 0)]
    return np.where(begin > 0, before, 0).astype(symbols.dtype)


def merge(a: Transform, b: Transform, m: int) -> Transform:
    """The transform of both shards' strings, a's first; lcp is in symbols, m at most."""
    na, n = len(a.order), len(a.order) + len(b.order)
    before = np.concatenate([a.before, b.before])
    z = np.zeros(n, np.bool_)
    z[na:] = True
    strings = a.strings + b.strings
    lcp = np.full(n, m, np.int8)
    block = np.zeros(n, np.int64)
    ends = np.zeros(strings, np.bool_)
    ends[a.strings :] = True
    for depth in range(m):
        entry = np.where(z, na + np.cumsum(z) - 1, np.cumsum(~z) - 1)
        symbol = before[entry]
        to = np.argsort(symbol, kind="stable")
        symbol, from_block = symbol[to], block[to]
        z = z[to]
        z[:strings] = ends  # the suffixes that are ends alone, in string order
        new = np.empty(n, np.bool_)
        new[0] = True
        new[1:] = (symbol[1:] != symbol[:-1]) | ((from_block[1:] != from_block[:-1]) & (symbol[1:] > 0))
        lcp[new & (lcp == m)] = depth
        block = np.cumsum(new)
    entry = np.where(z, na + np.cumsum(z) - 1, np.cumsum(~z) - 1)
    shift = a.strings * (m + 1)
    return Transform(np.concatenate([a.order, b.order + shift])[entry], before[entry], strings, lcp)


def repeated(symbols: np.ndarray, shards: int = 4) -> np.ndarray:
    """Which strings (rows of symbols) occur more than once."""
    n, m = symbols.shape
    if n < 2:
        return np.zeros(n, np.bool_)
    dense = np.unique(symbols, return_inverse=True)[1].reshape(n, m) + 1
    dense = dense.astype(np.uint16 if dense.max() < 65536 else np.int32)
    cuts = np.linspace(0, n, max(2, min(shards, n)) + 1).astype(int)
    parts = [build(dense[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    while len(parts) > 1:
        parts = [merge(parts[i], parts[i + 1], m) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    whole = parts[0]
    # intervals of common prefix m among the suffixes that are whole strings
    at = np.flatnonzero(whole.order % (m + 1) == 0)
    same = np.zeros(len(at), np.bool_)
    same[1:] = (whole.lcp[at[1:]] == m) & (at[1:] == at[:-1] + 1)
    same[:-1] |= same[1:]
    out = np.zeros(n, np.bool_)
    out[whole.order[at] // (m + 1)] = same
    return out
