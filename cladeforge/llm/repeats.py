"""Byte-level work on repeated passages: anchors of windows, and hashes of ranges. Plain numpy on one chunk of rows."""

from __future__ import annotations

import numpy as np

from . import textkit as tk

U64 = tk.U64


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values; len(values) - width + 1 of them."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of the windows of each row: a window's anchor is its leftmost ``gram``-byte string of least hash.

    Equal windows have equal anchors at equal places, wherever they stand. Consecutive windows with one anchor are a run;
    for each run: its row, the anchor's place, and the first and last of its windows (all as places in the chunk).
    """
    n = len(data)
    if n < window:
        return {k: np.zeros(0, np.int64) for k in ("row", "anchor", "first", "last")}
    sums = tk.prefix(data)
    at = np.arange(n - gram + 1)
    h = tk.span_hash(sums, at, at + gram)
    packed = (h & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    least = sliding_min(packed, window - gram + 1)
    place = (least & U64(0xFFFFFFFF)).astype(np.int64)
    p = np.arange(len(place))
    row = np.searchsorted(offsets, p, side="right") - 1
    inside = p + window <= offsets[row + 1]
    p, row, place = p[inside], row[inside], place[inside]
    if not len(p):
        return {k: np.zeros(0, np.int64) for k in ("row", "anchor", "first", "last")}
    new = np.ones(len(p), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return {"row": row[begin], "anchor": place[begin], "first": p[begin], "last": p[np.append(begin[1:], len(p)) - 1], "sums": sums, "hash": h}
