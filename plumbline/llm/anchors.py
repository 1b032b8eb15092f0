"""Content-defined anchors: every string of ``length`` bytes holds one, chosen by its own bytes alone (winnowing)."""

from __future__ import annotations

import numpy as np

from . import textbytes

PLACE_BITS = 26
PIECE = 48 << 20


def window_minimum(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by block-wise running minima from both sides."""
    n = len(key) - w + 1
    room = -(-len(key) // w) * w
    padded = np.full(room, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def cells(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int, reach: int, width: int) -> tuple[np.ndarray, ...]:
    """Cut runs of starts into cells of ``width`` distances to their anchor (0 to ``reach``).

    Run number, first and last start, hash of the bytes that all strings of the full cell have in common (the core) and
    hash of all bytes under the cell's own starts. Equal strings lie in cells of equal cores.
    """
    hashed, out = textbytes.SpanHash(data), []
    for i in range(-(-(reach + 1) // width)):
        lo, hi = np.maximum(first, anchor - (i + 1) * width + 1), np.minimum(last, anchor - i * width)
        run = np.flatnonzero(lo <= hi)
        lo, hi, a = lo[run], hi[run], anchor[run]
        core = hashed.spans(a - i * width, a + length - (i + 1) * width + 1) ^ np.uint64(i * 0x9E37 + width)
        whole = hashed.spans(lo, hi + length) ^ textbytes.mix((a - lo).astype(np.uint64))
        out.append((run, lo, hi, core.view(np.int64), whole.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors(raw: np.ndarray, at: np.ndarray, length: int, k: int, parts: int) -> tuple[np.ndarray, ...]:
    """For all strings of ``length`` bytes inside the texts: cells of starts that share an anchor.

    Text number, first and last start, anchor's distance from the first start, core and whole hash. Starts count from
    the beginning of the text; a cell spans a ``parts``-th of the possible distances.
    """
    reach = length - k
    width = -(-(reach + 1) // parts)
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    rows = np.flatnonzero(np.diff(at) >= length)
    groups, begin = [], 0
    while begin < len(rows):  # texts in order, as many as fit a piece; a longer one is cut into overlapping pieces
        end = begin + 1
        while end < len(rows) and at[rows[end] + 1] - at[rows[begin]] <= PIECE:
            end += 1
        a, b = int(at[rows[begin]]), int(at[rows[end - 1] + 1])
        step = b - a if b - a <= PIECE else PIECE - length
        groups += [(s, min(b, s + step + length - 1)) for s in range(a, max(a + 1, b - length + 1), step)]
        begin = end
    for a, b in groups:
        data = raw[a:b]
        grams = textbytes.SpanHash(data).windows(k)
        bits = np.uint64(PLACE_BITS)
        key = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
        best = window_minimum(key, length - k + 1)
        place = (best & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        text = np.searchsorted(at, np.arange(a, a + len(place)), side="right") - 1
        inside = np.arange(a, a + len(place)) + length <= at[text + 1]
        start = np.flatnonzero(inside)
        if not len(start):
            continue
        place, text = place[start], text[start]
        new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(start)) - 1
        p, q, t, j = start[lo], start[hi], text[lo], place[lo]
        run, lo, hi, core, whole = cells(data, p, q, j, length, reach, width)
        for o, v in zip(out, (t[run], lo + a - at[t[run]], hi + a - at[t[run]], j[run] - lo, core, whole), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
