"""Induced sorting of suffixes around sampled places, with common-prefix values. Plain numpy on whole groups of suffixes."""

from __future__ import annotations

import numpy as np


def range_minimum(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Minimum of values[i..j], both included and i <= j, for each pair."""
    if not len(i):
        return values[:0]
    level = np.frexp((j - i + 1).astype(np.float64))[1] - 1
    out = np.empty(len(i), dtype=values.dtype)
    table, width = values, 1
    for k in range(int(level.max()) + 1):
        here = level == k
        out[here] = np.minimum(table[i[here]], table[j[here] - width + 1])
        table, width = np.minimum(table[: max(len(table) - width, 0)], table[width:]), 2 * width
    return out


def padded(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row, filled up with zeros, and the rows' lengths."""
    size = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.zeros((len(rows), int(size.max(initial=0)) + 1), dtype=np.uint8)
    out[np.repeat(np.arange(len(rows)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(rows), np.uint8)
    return out, size


def common_prefixes(group: np.ndarray, right: list[bytes]) -> np.ndarray:
    """Common-prefix value of each suffix with the one before it in order; -1 where another group begins."""
    body, size = padded(right)
    same = body[1:] == body[:-1]
    same[:, -1] = False
    out = np.full(len(right), -1, dtype=np.int32)
    out[1:] = np.minimum(np.where(group[1:] == group[:-1], same.argmin(axis=1), -1), np.minimum(size[1:], size[:-1]))
    return out


def repeated_starts(group: np.ndarray, right: list[bytes], left: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes that begin before the sampled ones have a neighbour that shares ``window`` bytes.

    The sampled suffixes ``right`` come in order of (group, bytes); ``left`` is what stands before each. As in induced
    sorting, the order of the suffixes one byte further to the left follows from that of the last step by a stable sort on
    that byte, and the common-prefix value of two neighbours is one more than the least value between them in the last
    order. Values are held from the sampled place on; -1 stands for a difference before it. A suffix leaves once no suffix
    can share a window with it any more. Windows hold the sampled place's first byte at least. Returns (row, bytes before the sampled place) of each start that repeats.
    """
    before, lead = padded([x[::-1] for x in left])
    rows, value = np.arange(len(right)), common_prefixes(group, right)
    found_row, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(min(int(lead.max(initial=0)) + 1, window)):
        if d:
            byte = before[rows, d - 1]
            order = np.argsort(byte, kind="stable")
            i, j = order[:-1], order[1:]
            same = byte[i] == byte[j]
            induced = np.full(len(rows), -1, dtype=np.int32)
            induced[1:][same] = range_minimum(value, i[same] + 1, j[same])
            rows, value = rows[order], induced
        best = np.maximum(value, np.append(value[1:], -1))
        hit = best >= window - d
        found_row.append(rows[hit])
        found_d.append(np.full(int(hit.sum()), d))
        # to share a window further to the left, a suffix must have bytes there, and a partner close enough to the right
        stay = np.flatnonzero((lead[rows] > d) & (best >= window - lead[rows]))
        if not len(stay):
            break
        least = np.full(len(stay), -1, dtype=np.int32)
        if len(stay) > 1:
            least[1:] = np.minimum.reduceat(value[: stay[-1] + 1], stay[:-1] + 1)
        rows, value = rows[stay], least
    return np.concatenate(found_row), np.concatenate(found_d)
