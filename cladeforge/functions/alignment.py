"""Pairwise alignment of columns, in Arrow batches.

One numpy step handles an antidiagonal of the dynamic program for all pairs of a batch. Costs are minimised. Two settings are
offered, which are not interchangeable: ``affine`` (global; mismatch 4, gap of n 6 + 2 n; ``affine2``: the lesser of that and
24 + n, so long gaps cost less) and ``nw`` (free end gaps; match 2, mismatch -1, gap of n -3 - n, as negated costs).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from . import bit_alignment

#: Cells of the dynamic program that are held at once.
CELLS = 96_000_000
#: Times CELLS bytes of moves of pairs that are taken apart by their sizes are held at once: many thin programs together, since
#: a step has a cost of its own.
HELD = 4
#: Cells that take as long as one step of a program takes however few its pairs.
STEP_CELLS = 15_000
#: Bytes of an antidiagonal in one array of ``_by_differences``, so that its arrays stay in a core's cache.
CACHED = 65_536
#: Lengths of first sides that stand together, as a ratio.
LIKE = 1.25
FAR = 1 << 28
DIAGONAL, UP, LEFT, UP_OPENS, LEFT_OPENS = 0, 1, 2, 4, 8
#: Bit of a gap of the second piece, and of where one opens.
SECOND, UP2_OPENS, LEFT2_OPENS = 16, 32, 64


@dataclass(frozen=True)
class Scoring:
    """Costs; ``free_ends`` leaves gaps at the ends of either sequence without cost; ``sign`` turns costs into the score told.

    ``second``: opening and extending of a gap's second piece, where a gap costs the lesser of both.
    """

    match: int = 0
    mismatch: int = 4
    opening: int = 6
    extending: int = 2
    free_ends: bool = False
    sign: int = 1
    gaps_first: bool = False
    second: tuple[int, int] | None = None


# The two settings, and the metrics that are affine costs too.
SCORINGS = {
    "affine": Scoring(),
    "affine2": Scoring(second=(24, 1)),
    "nw": Scoring(match=-2, mismatch=1, opening=3, extending=1, free_ends=True, sign=-1, gaps_first=True),
    "linear": Scoring(opening=0),
    "edit": Scoring(mismatch=1, opening=0, extending=1),
    "indel": Scoring(mismatch=FAR >> 8, opening=0, extending=1),
}


def _padded(rows: list[str], fill: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Letters as (place, row), filled up, and the rows' lengths."""
    size = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.full((max(int(size.max(initial=0)), 1), len(rows)), fill, dtype=kind)
    for k, r in enumerate(rows):
        out[: len(r), k] = np.frombuffer(r.encode("ascii", "replace"), dtype=np.uint8)
    return out, size


class _Program:
    """The dynamic program of a batch, an antidiagonal of all its pairs at a time; letters of ``a`` go down, those of ``b`` right.

    A state is (costs of the last antidiagonal and the one before, costs that end in a gap along the row and down the
    column, the windows of both antidiagonals): arrays by place in ``a``, with a spare place in front. ``limit``: cells above it, and above the least
    of their antidiagonal and ``slack``, leave the window, so that work follows the score.
    """

    def __init__(self, a: list[str], b: list[str], scoring: Scoring, limit: int | None, slack: int | None):
        self.scoring, self.size = scoring, len(a)
        if scoring.second is not None and (scoring.gaps_first or scoring.free_ends):
            raise ValueError("two pieces are for global alignment, the diagonal first")
        longest = max(map(len, a), default=0) + max(map(len, b), default=0)
        # no cell costs more than gaps alone, and a mismatch that costs more than two gaps is never taken
        self.mismatch = min(scoring.mismatch, 2 * (scoring.opening + scoring.extending) + 1)
        worst = 2 * scoring.opening + (longest + 2) * max(abs(scoring.match), scoring.extending) + self.mismatch
        self.kind, self.far = (np.int16, 1 << 14) if worst < 12_000 else (np.int32, FAR)
        self.x, self.n = _padded(a, 0, self.kind)
        y, self.m = _padded(b, 1, self.kind)
        self.backwards = np.ascontiguousarray(y[::-1])
        self.height, self.width = len(self.x), len(y)
        self.limit = self.far - 1 if limit is None else min(limit, self.far - 1)
        self.slack, self.bounded = slack, limit is not None or slack is not None
        self.buffers = [np.empty((self.height + 1, self.size), dtype=self.kind) for _ in range(5)]

    def start(self) -> list:
        arrays = [np.full((self.height + 2, self.size), self.far, dtype=self.kind) for _ in range(4 if self.scoring.second is None else 6)]
        arrays[0][1] = 0
        return [*arrays[:4], (0, 0), None, *arrays[4:]]

    @staticmethod
    def copied(state: list) -> list:
        return [x.copy() if isinstance(x, np.ndarray) else x for x in state]

    def row(self, state: list, d: int, moves: bool) -> tuple[int, np.ndarray | None]:
        """Go on to antidiagonal ``d``; returns the first place of its cells, and their moves if asked for."""
        h, before, right, down, last_window, window_before, *more = state
        s, both, ext = self.scoring, self.scoring.opening + self.scoring.extending, self.scoring.extending
        # gaps come from the last antidiagonal, pairs of letters from the one before
        reach = [w for w in (last_window, window_before) if w is not None]
        lowest, highest = min(w[0] for w in reach), max(w[1] for w in reach)
        low, high = max(min(w[0] + (w is window_before) for w in reach), d - self.width, 0), min(highest + 1, d, self.height)
        if low > high:
            state[0], state[1], state[4], state[5] = before, h, None, last_window
            return low, None
        k = high - low + 1
        diagonal, step, best, opened, extended = (b[:k] for b in self.buffers)
        # place i stands at i + 1; the one above it at i
        here, above = slice(low + 1, high + 2), slice(low, high + 1)
        flags = None
        np.add(h[above], both, out=opened)
        np.add(down[above], ext, out=extended)
        if moves:
            flags = (opened <= extended).view(np.uint8) << 2
        new_down = np.minimum(opened, extended)
        np.add(h[here], both, out=opened)
        np.add(right[here], ext, out=extended)
        if moves:
            flags |= (opened <= extended).view(np.uint8) << 3
        np.minimum(opened, extended, out=right[here])
        if low == 0:
            new_down[0] = self.far
        if high == d:
            right[d + 1] = self.far
        if more:
            right2, down2 = more
            both2, ext2 = sum(s.second), s.second[1]
            np.add(h[above], both2, out=opened)
            np.add(down2[above], ext2, out=extended)
            if moves:
                flags |= (opened <= extended).view(np.uint8) << 5
            new_down2 = np.minimum(opened, extended)
            np.add(h[here], both2, out=opened)
            np.add(right2[here], ext2, out=extended)
            if moves:
                flags |= (opened <= extended).view(np.uint8) << 6
            np.minimum(opened, extended, out=right2[here])
            if low == 0:
                new_down2[0] = self.far
            if high == d:
                right2[d + 1] = self.far
        # the letter of b at i is d - i - 1: with b backwards both run the same way
        first, last = max(low, 1), min(high, d - 1)
        diagonal[: first - low] = diagonal[last - low + 1 :] = self.far
        if first <= last:
            part = diagonal[first - low : last - low + 1]
            t, at = step[: last - first + 1], self.width - d
            np.bitwise_xor(self.x[first - 1 : last], self.backwards[at + first : at + last + 1], out=t)
            np.minimum(t, 1, out=t)
            t *= self.mismatch - s.match
            np.add(before[first : last + 1], s.match, out=part)
            part += t
        np.minimum(diagonal, new_down, out=best)
        np.minimum(best, right[here], out=best)
        if more:
            np.minimum(best, new_down2, out=best)
            np.minimum(best, right2[here], out=best)
        if s.free_ends:
            if low == 0:
                best[0] = 0
            if high == d:
                best[d - low] = new_down[d - low] = 0
        if moves:
            if s.gaps_first:
                across, below = right[here] != best, new_down != best
                flags |= (~across).view(np.uint8) * LEFT + (across & ~below).view(np.uint8)
            elif more:
                # in order: the diagonal, up, left, up and left of the second piece
                across = diagonal != best
                past_up = across & (new_down != best)
                past_left = past_up & (right[here] != best)
                past_up2 = past_left & (new_down2 != best)
                flags |= across.view(np.uint8) + past_up + past_left * np.uint8(SECOND - 1) + past_up2
            else:
                across = diagonal != best
                flags |= across.view(np.uint8) + (across & (new_down != best)).view(np.uint8)
        down[here] = new_down
        if more:
            down2[here] = new_down2
        before[here] = best
        state[0], state[1] = before, h
        cells, window = before, (low, high)
        if self.bounded:
            # a pair that has ended has no say, and places that leave the window cost too much for all
            alive = (self.n + self.m >= d)[None, :]
            bound = self.limit if self.slack is None else np.minimum(np.where(alive, best, self.far).min(axis=0) + self.slack, self.limit)
            near = np.flatnonzero(((best <= bound) & alive).any(axis=1))
            window = (low + int(near[0]), low + int(near[-1])) if len(near) else None
            begin, end = min(low, lowest) + 1, max(high, highest) + 2
            for array in (cells, right, down, *more):
                if window is None:
                    array[begin:end] = self.far
                else:
                    array[begin : window[0] + 1] = self.far
                    array[window[1] + 2 : end] = self.far
        state[4], state[5] = window, last_window
        return low, flags


def align_batch(a: list[str], b: list[str], scoring: Scoring, cap: int | None = None, slack: int | None = None) -> tuple[list[int | None], list[str]]:
    """Score and moves (M match, X mismatch, D letter of ``a`` alone, I letter of ``b`` alone) of each pair.

    Ties go to the diagonal, then to D, then to I; with ``gaps_first`` to I, then D, then the diagonal. ``cap``: a pair whose
    cost is above it has no score (None), and no cells above it are worked on; for settings that charge for gaps at the
    ends. ``slack``: cells that cost so much more than the best of their antidiagonal are given up, which is faster for
    similar pairs and not exact. Moves are held for CELLS cells at most: of larger programs the states of some antidiagonals
    are, and the moves between two of them are made again on the way back.
    """
    if not a:
        return [], []
    if cap is not None and scoring.free_ends:
        raise ValueError("a cap needs costs that never fall")
    return _by_size(a, b, scoring) if in_bytes(scoring, cap, slack) else _by_costs(a, b, scoring, cap, slack)


def in_bytes(scoring: Scoring, cap: int | None = None, slack: int | None = None) -> bool:
    """Whether ``align_batch`` takes pairs apart by their sizes: a batch may be of any, and the larger the faster."""
    return cap is None and slack is None and scoring.second is None and 0 < scoring.opening < 8 and scoring.opening + scoring.extending <= 16


def _by_size(a: list[str], b: list[str], scoring: Scoring) -> tuple[list[int], list[str]]:
    """``align_batch`` part by part of like sizes, as many at once as HELD times CELLS bytes hold; a pair that is larger goes by its costs."""
    n, m = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    gap = np.where((n + m > 0) & (not scoring.free_ends), scoring.opening + scoring.extending * (n + m), 0) * scoring.sign
    # those with an empty side need no program
    scores, paths = gap.tolist(), ["D" * x + "I" * y for x, y in zip(n.tolist(), m.tolist(), strict=True)]
    held: list[np.ndarray] = []
    cells = 0

    def settle(some: list[np.ndarray]) -> None:
        ids = np.concatenate(some).tolist()
        left, right = [a[k] for k in ids], [b[k] for k in ids]
        ends = np.cumsum([len(p) for p in some])
        fits = len(ids) > 1 or (n[ids[0]] + 1) * (m[ids[0]] + 1) < HELD * CELLS
        told = _by_differences(left, right, scoring, [np.arange(e - len(p), e) for p, e in zip(some, ends, strict=True)]) if fits else _by_costs(left, right, scoring, None, None)
        for k, score, path in zip(ids, *told, strict=True):
            scores[k], paths[k] = score, path

    rest = np.flatnonzero((n > 0) & (m > 0))
    if in_bits(scoring):
        parts, rest = bit_alignment.parts(rest, n, m, LIKE, HELD * CELLS)
        for some in _together(parts, n, m):
            ids = np.concatenate(some).tolist()
            for k, score, path in zip(ids, *_by_bits([a[k] for k in ids], [b[k] for k in ids], scoring, some), strict=True):
                scores[k], paths[k] = score, path
    for part in _parts(rest, n, m):
        size = (int(n[part].max()) + 1) * (int(m[part].max()) + 1) * len(part)
        if held and cells + size > HELD * CELLS:
            settle(held)
            held, cells = [], 0
        held.append(part)
        cells += size
    if held:
        settle(held)
    return scores, paths


def in_bits(scoring: Scoring) -> bool:
    """Whether large pairs go by bits, which hold little of them; the more pairs at once the faster."""
    return (scoring.match, scoring.mismatch, scoring.opening, scoring.extending) == (0, 4, 6, 2) and not scoring.free_ends and not scoring.gaps_first and scoring.second is None


def _together(parts: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Parts whose states fit HELD times CELLS bytes at once, so that all of their pairs go back together."""
    some: list[np.ndarray] = []
    held = 0
    for part in parts:
        cells = bit_alignment.held_cells(len(part), int(n[part].max()), int(m[part].max()))
        if some and (held + cells) * 2 > HELD * CELLS:
            yield some
            some, held = [], 0
        some.append(part)
        held += cells
    if some:
        yield some


def _by_bits(a: list[str], b: list[str], scoring: Scoring, parts: list[np.ndarray]) -> tuple[list[int], list[str]]:
    """``align_batch`` of pairs that are listed part by part, by bits."""
    n, m = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    ends = np.cumsum([len(p) for p in parts])
    groups = [np.arange(e - len(p), e) for p, e in zip(parts, ends, strict=True)]
    cells = sum(bit_alignment.held_cells(len(p), int(n[p].max()), int(m[p].max())) for p in groups)
    step, after = _steps(replace(scoring, opening=bit_alignment.OPENING))
    trail, _, _ = bit_alignment.align(a, b, groups, _room(2 * cells).reshape(2, cells), step, after << 8)
    return _told(a, b, n, m, trail, [""] * len(a), scoring, np.zeros(len(a), dtype=np.int64))


def _by_costs(a: list[str], b: list[str], scoring: Scoring, cap: int | None, slack: int | None) -> tuple[list[int | None], list[str]]:
    """``align_batch`` by a program of the whole batch that holds costs."""
    program = _Program(a, b, scoring, cap, slack)
    n, m, size, far = program.n, program.m, program.size, program.far
    lanes, total = np.arange(size), program.height + program.width
    block = max(CELLS // ((program.height + 1) * size), 1)
    whole = block >= total or (program.height + 1) * (program.width + 1) * size <= CELLS
    state, saved, kept = program.start(), {}, _Moves(size, program.height * program.width + total if whole else 0)
    ends = n + m
    ending: dict[int, list[int]] = {}
    for k, d in enumerate(ends.tolist()):
        ending.setdefault(d, []).append(k)
    score = np.where(ends == 0, 0, far).astype(np.int64)
    tails = [""] * size
    i, j = n.copy(), m.copy()
    if scoring.free_ends:
        by_col, by_row = np.zeros((2, size), np.int64) + far  # least of the last column and of the last row
        col_at, row_at = np.zeros((2, size), np.int64)
        by_col[m == 0], by_row[n == 0] = 0, 0
    for d in range(1, total + 1):
        if not whole and (d - 1) % block == 0:
            saved[d] = program.copied(state)
        low, flags = program.row(state, d, whole)
        if whole and flags is not None:
            kept.add(d, low, flags)
        if state[4] is None and state[5] is None:
            break
        cells = state[0]
        if d in ending:
            score[ending[d]] = cells[n[ending[d]] + 1, ending[d]]
        if scoring.free_ends:
            at = d - m
            on = (at >= 0) & (at <= n)
            value = np.where(on, cells[np.where(on, at, 0) + 1, lanes], far)
            better = on & (value <= by_col)
            by_col, col_at = np.where(better, value, by_col), np.where(better, at, col_at)
            on = (d >= n) & (d - n <= m)
            value = np.where(on, cells[n + 1, lanes], far)
            better = on & (value <= by_row)
            by_row, row_at = np.where(better, value, by_row), np.where(better, d - n, row_at)
    if scoring.free_ends:
        # the longest overlap: the last place with the best score
        score = np.minimum(by_col, by_row)
        i, j = np.where(by_col <= by_row, col_at, n), np.where(by_col <= by_row, m, row_at)
        tails = ["D" * int(p) + "I" * int(q) for p, q in zip(n - i, m - j, strict=True)]
    found = score <= (program.limit if program.bounded else far)
    found &= score < far
    i, j = np.where(found, i, 0), np.where(found, j, 0)
    # the way back of each pair, block by block of antidiagonals: a byte a step
    trails, held = [bytearray() for _ in range(size)], [-1] * size
    at = list(zip(i.tolist(), j.tolist(), strict=True))
    for begin in [1] if whole else sorted(saved, reverse=True):
        if not whole:
            here = saved.pop(begin)
            kept = _Moves(size, block * (program.height + 1))
            for d in range(begin, min(begin + block, total + 1)):
                low, flags = program.row(here, d, True)
                if flags is not None:
                    kept.add(d, low, flags)
        for k in range(size):
            at[k], held[k] = _way_back(kept, k, a[k], b[k], at[k], held[k], begin, trails[k])
    paths = [trails[k][::-1].decode() + tails[k] if found[k] else "" for k in range(size)]
    return [int(x) * scoring.sign if ok else None for x, ok in zip(score, found, strict=True)], paths


#: Where the way back of ``_by_differences`` stops, and states on it: none, in a gap down, in a gap along the row.
STOP, IN_DOWN, IN_RIGHT = 255, 1, 2
#: Steps of all ways back after which those that have ended are left out.
CHECKED = 32


def _steps(scoring: Scoring) -> tuple[np.ndarray, np.ndarray]:
    """Step taken (0 none, 1 diagonal, 2 up, 3 left) and the state after it, by state * 256 + move.

    A move holds how much a gap down (bits 0 to 2) and one along the row (bits 3 to 5) cost above their cell, ``opening`` at
    most, and whether the diagonal costs more than the cell (bit 6). A gap goes on in the cell it comes from unless opening
    there costs no more, which is when it is ``opening`` above that cell.
    """
    step, after = np.zeros(3 * 256, dtype=np.int64), np.zeros(3 * 256, dtype=np.int64)
    for state in range(3):
        for move in range(128):
            down, right, past = move & 7, move >> 3 & 7, move >> 6
            now = state
            if state == IN_DOWN and down == scoring.opening or state == IN_RIGHT and right == scoring.opening:
                now = 0
            if not now:
                if scoring.gaps_first:
                    now = IN_RIGHT if not right else IN_DOWN if not down else 0
                elif past:
                    now = IN_DOWN if not down else IN_RIGHT
            step[state * 256 + move], after[state * 256 + move] = now + 1, now
    return step, after


def _forward(a: list[str], b: list[str], scoring: Scoring, flat: np.ndarray, at: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Moves of a few pairs into ``flat`` from ``at`` on: that of place u and pair k of antidiagonal d is at ``base[d] + u * size + k``.

    What is held is not costs but what they differ by from cell to cell, in bytes (less ``extending``): ``down`` of a cell and
    the one above, ``across`` of a cell and the one to its left; and ``gap_down``, ``gap_right``: how much a gap that ends in a
    cell costs above it, ``opening`` at most. Returns, with free ends, the differences down the last column of each pair and along
    its last row, by antidiagonal; and where the moves end.
    """
    size, o, e = len(a), scoring.opening, scoring.extending
    x, n = _padded(a, 0, np.uint8)
    y, m = _padded(b, 1, np.uint8)
    y = np.ascontiguousarray(y[::-1])
    height, width = len(x), len(y)
    total, most = height + width, min(height, width)
    mismatch = min(scoring.mismatch, 2 * (o + e) + 1)
    edge = -e if scoring.free_ends else 0
    down, new_down, across = (np.full((height + 2, size), edge, dtype=np.int8) for _ in range(3))
    gap_down, gap_right = (np.full((height + 2, size), o, dtype=np.int8) for _ in range(2))
    open_ = np.full((most, size), o, dtype=np.int8)
    cost, up, left, best = (np.empty((most, size), dtype=np.int8) for _ in range(4))
    same, gain, more = cost.view(bool), np.int8(scoring.match - mismatch), mismatch - 2 * e
    lanes = np.arange(size)
    last_column = np.zeros((total + 1 if scoring.free_ends else 0, size), dtype=np.int8)
    last_row = np.zeros((total + 1 if scoring.free_ends else 0, size), dtype=np.int8)
    eight, sixty_four = np.int8(8), np.int8(64)
    in_column, in_row = lanes - m * size, n * size + lanes
    if not scoring.free_ends:
        down[1] = across[0] = o
    moves = flat.view(np.int8)
    base[0], base[1] = at, at + size
    flat[at : at + 3 * size] = STOP
    at += 3 * size
    for d in range(2, total + 1):
        low, high = max(1, d - width), min(height, d - 1)
        k = high - low + 1
        here, above = slice(low, high + 1), slice(low - 1, high)
        s, p, q, z, o_ = cost[:k], up[:k], left[:k], best[:k], open_[:k]
        across_above, down_here, gap_right_here, gap_down_here = across[above], down[here], gap_right[here], gap_down[here]
        np.equal(x[above], y[width - d + low : width - d + high + 1], out=same[:k])
        np.multiply(s, gain, out=s)
        if more:
            np.add(s, np.int8(more), out=s)
        np.add(gap_down[above], across_above, out=p)
        np.add(gap_right_here, down_here, out=q)
        np.minimum(p, q, out=z)
        np.minimum(z, s, out=z)
        np.subtract(z, across_above, out=new_down[here])
        np.subtract(z, down_here, out=across[here])
        np.subtract(p, z, out=p)
        np.subtract(q, z, out=q)
        np.minimum(p, o_, out=gap_down_here)
        np.minimum(q, o_, out=gap_right_here)
        down, new_down = new_down, down
        if d == 2:
            across[0] = edge
        # the cells of the edges are held too, where the way back stops
        first, last = max(0, d - width), min(height, d)
        base[d] = at - first * size
        if first < low:
            flat[at : at + size] = STOP
            at += size
        f = moves[at : at + k * size].reshape(k, size)
        np.multiply(gap_right_here, eight, out=f)
        np.add(f, gap_down_here, out=f)
        if not scoring.gaps_first:
            np.not_equal(s, z, out=same[:k])
            np.multiply(s, sixty_four, out=s)
            np.add(f, s, out=f)
        at += k * size
        if last > high:
            flat[at : at + size] = STOP
            at += size
        if scoring.free_ends:
            np.take(down, in_column + d * size, mode="clip", out=last_column[d])
            np.take(across, in_row, mode="clip", out=last_row[d])
    return last_column, last_row, at


#: Bytes of moves that a worker holds from one batch to the next: new memory takes longer than the moves written into it.
_held = np.empty(0, dtype=np.uint8)


def _room(size: int) -> np.ndarray:
    global _held
    if size > HELD * CELLS:
        return np.empty(size, dtype=np.uint8)
    if len(_held) < size:
        _held = np.empty(min(size + size // 2, HELD * CELLS), dtype=np.uint8)
    return _held[:size]


def _parts(able: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """Pairs by size, in parts whose antidiagonals fit CACHED, begun anew where filling up costs more than antidiagonals of their own.

    Those of like first sides stand together, by their second sides. A part of more than one pair fits HELD times CELLS bytes.
    """
    parts, part, h, w = [], [], 0, 0
    like = np.floor(np.log(np.maximum(n[able], 1)) / math.log(LIKE))
    for k in able[np.lexsort((n[able], m[able], like))].tolist():
        x, y = int(n[k]), int(m[k])
        new_h, new_w = max(h, x), max(w, y)
        full = len(part) >= max(CACHED // (min(new_h, new_w) + 1), 8) or (new_h + 1) * (new_w + 1) * (len(part) + 1) > HELD * CELLS
        if part and (full or new_h * new_w * (len(part) + 1) - h * w * len(part) > x * y + STEP_CELLS * (x + y)):
            parts.append(np.array(part))
            part, new_h, new_w = [], x, y
        part.append(k)
        h, w = new_h, new_w
    return [*parts, np.array(part)] if part else parts


def _by_differences(a: list[str], b: list[str], scoring: Scoring, parts: list[np.ndarray] | None = None) -> tuple[list[int], list[str]]:
    """``align_batch`` for affine costs without a bound, in bytes: a few pairs at a time forward, the way back of all pairs at once."""
    size, o, e = len(a), scoring.opening, scoring.extending
    n, m = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    total = int(n.max() + m.max())
    able = np.flatnonzero((n > 0) & (m > 0))
    parts = _parts(able, n, m) if parts is None else parts
    flat = _room(sum((int(n[p].max()) + 1) * (int(m[p].max()) + 1) * len(p) for p in parts))
    base, at = np.zeros((max(len(parts), 1), total + 1), dtype=np.int64), 0
    part, stride, lane = (np.zeros(size, dtype=np.int64) for _ in range(3))
    u, v = n.copy(), m.copy()
    score = np.zeros(size, dtype=np.int64)
    for g, p in enumerate(parts):
        down, across, at = _forward([a[k] for k in p], [b[k] for k in p], scoring, flat, at, base[g])
        part[p], stride[p], lane[p] = g, len(p), np.arange(len(p))
        if not scoring.free_ends:
            continue
        for x, k in enumerate(p.tolist()):
            h, w = int(n[k]), int(m[k])
            # differences of the first row and column are the edge's; those below and beyond it were found
            column = np.concatenate([[0], np.cumsum(down[w + 1 : w + h + 1, x].astype(np.int64) + e)])
            row = np.concatenate([[0], np.cumsum(across[h + 1 : h + w + 1, x].astype(np.int64) + e)])
            by_column, by_row = int(column.min()), int(row.min())
            score[k] = min(by_column, by_row)
            # the longest overlap: the last place with the best score
            if by_column <= by_row:
                u[k] = h - int(column[::-1].argmin())
            else:
                v[k] = w - int(row[::-1].argmin())
    tails = ["D" * int(p) + "I" * int(q) for p, q in zip(n - u, m - v, strict=True)]
    # all ways back together: a step of each at a time, of which the state and the move are kept
    step, after = _steps(scoring)
    after <<= 8
    back, rise = np.array([0, 2, 1, 1])[step], np.array([0, 1, 1, 0])[step]
    trail = np.zeros((size, total + CHECKED), dtype=np.uint8)
    live, t = able[(u[able] > 0) & (v[able] > 0)], 0
    held = []
    state, width = np.zeros(len(live), dtype=np.int64), stride[live]
    row, place = part[live] * (total + 1) + u[live] + v[live], u[live] * width + lane[live]
    starts = base.ravel()
    while len(live):
        at_ = starts.take(row)
        at_ += place
        key = flat.take(at_) + state
        held.append(key)
        state = after.take(key)
        row -= back.take(key)
        place -= rise.take(key) * width
        t += 1
        if t % CHECKED == 0:
            keys = np.stack(held, axis=1)
            trail[live, t - CHECKED : t] = step[keys]
            held = []
            on = keys[:, -1] & 255 != STOP
            if not on.all():
                live, state, width, row, place = (z[on] for z in (live, state, width, row, place))
    return _told(a, b, u, v, trail, tails, scoring, score)


def _told(a: list[str], b: list[str], u: np.ndarray, v: np.ndarray, trail: np.ndarray, tails: list[str], scoring: Scoring, score: np.ndarray) -> tuple[list[int], list[str]]:
    """Scores and moves of the ways back ``trail`` that begin at ``u, v``; scores of free ends are known (``score``)."""
    size, o, e = len(a), scoring.opening, scoring.extending
    n, m = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    names, paths = np.frombuffer(b"\0MDI", dtype=np.uint8), []
    for k in range(size):
        taken = trail[k]
        taken = taken[taken > 0][::-1]
        path = names[taken]
        u_, v_ = np.cumsum(taken != 3), np.cumsum(taken != 2)
        # what is left of either side stands before the way back
        first_u, first_v = (int(u[k] - u_[-1]), int(v[k] - v_[-1])) if len(taken) else (int(u[k]), int(v[k]))
        at_a, at_b = first_u + u_ - 1, first_v + v_ - 1
        both = np.flatnonzero(taken == 1)
        left, right = (np.frombuffer(z.encode("ascii", "replace"), dtype=np.uint8) for z in (a[k], b[k]))
        differ = both[left[at_a[both]] != right[at_b[both]]]
        path[differ] = b"X"[0]
        paths.append("I" * first_v + "D" * first_u + path.tobytes().decode() + tails[k])
        if not scoring.free_ends:
            gaps = np.flatnonzero(np.diff(taken, prepend=0) != 0)
            opened = int((taken[gaps] > 1).sum()) + (first_u > 0) + (first_v > 0)
            # a gap that goes on where the way back begins is opened once
            opened -= bool(len(taken)) and (taken[0] == 2 and first_u > 0 or taken[0] == 3 and first_v > 0 and not first_u)
            score[k] = scoring.match * (len(both) - len(differ)) + min(scoring.mismatch, 2 * (o + e) + 1) * len(differ) + o * opened + e * (n[k] + m[k] - 2 * len(both))
    return [int(x) * scoring.sign for x in score], paths


class _Moves:
    """Moves of antidiagonals one after another: that of place u and pair k of d is ``flat[base[d] + u * size + k]``."""

    def __init__(self, size: int, cells: int):
        self.size, self.at, self.base = size, 0, {}
        self.held = np.empty(cells * size, dtype=np.uint8)
        self.flat = memoryview(self.held)

    def add(self, d: int, low: int, flags: np.ndarray) -> None:
        self.base[d] = self.at - low * self.size
        self.held[self.at : self.at + flags.size] = flags.ravel()
        self.at += flags.size


def _way_back(kept: _Moves, k: int, a: str, b: str, at: tuple[int, int], state: int, begin: int, out: bytearray) -> tuple[tuple[int, int], int]:
    """Moves of pair ``k`` from a cell back to antidiagonal ``begin``, added to ``out``; where it came to, and in which state."""
    (u, v), flat, base, size = at, kept.flat, kept.base, kept.size
    while u + v >= begin:
        if u and v:
            byte = flat[base[u + v] + u * size + k]
            now = state if state >= 0 else byte & (SECOND | 3)
        else:
            byte, now = UP_OPENS | LEFT_OPENS, UP if u else LEFT
        if now == DIAGONAL:
            u, v, state = u - 1, v - 1, -1
            out.append(77 if a[u] == b[v] else 88)
        elif now & 3 == UP:
            u, state = u - 1, -1 if byte & (UP_OPENS if now == UP else UP2_OPENS) else now
            out.append(68)
        else:
            v, state = v - 1, -1 if byte & (LEFT_OPENS if now == LEFT else LEFT2_OPENS) else now
            out.append(73)
    return (u, v), state


def run_lengths(path: str) -> str:
    """CIGAR of a string of moves."""
    if not path:
        return ""
    codes = np.frombuffer(path.encode(), dtype=np.uint8)
    at = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
    return "".join(f"{e - s}{path[s]}" for s, e in zip(at[:-1], at[1:], strict=True))


def site_counts(a: str, b: str, path: str) -> tuple[int, int]:
    """Differing and comparable sites of an alignment: N and gaps are left out pair by pair."""
    ops = np.frombuffer(path.encode(), dtype=np.uint8)
    in_a, in_b = np.cumsum(ops != b"I"[0]) - 1, np.cumsum(ops != b"D"[0]) - 1
    both = (ops == b"M"[0]) | (ops == b"X"[0])
    u, v = np.frombuffer(a.encode(), np.uint8)[in_a[both]], np.frombuffer(b.encode(), np.uint8)[in_b[both]]
    known = (u != b"N"[0]) & (v != b"N"[0])
    return int(((u != v) & known).sum()), int(known.sum())


def like_sizes(pairs: set[tuple[str, str]], whole: bool = False) -> Iterator[list[tuple[str, str]]]:
    """Pairs in groups whose programs fit CELLS cells, filled up to the largest of a group.

    A new group begins where filling up costs more than the antidiagonals of a program of its own, which take as long as
    STEP_CELLS cells each. ``whole``: they are taken apart later (``in_bytes``), so only their own cells are counted here.
    """
    steps = lambda text: int(math.log(len(text) + 1) / math.log(LIKE))
    group: list[tuple[str, str]] = []
    h = w = 0
    for x, y in sorted(pairs, key=lambda p: (steps(p[0]), len(p[1]), len(p[0]), p)):
        if whole:
            cells = (len(x) + 1) * (len(y) + 1)
            if group and h + cells > HELD * CELLS:
                yield group
                group, h = [], 0
            group.append((x, y))
            h += cells
            continue
        new_h, new_w = max(h, len(x) + 1), max(w, len(y) + 1)
        filled = new_h * new_w * (len(group) + 1)
        if group and (filled > CELLS or filled - h * w * len(group) > (len(x) + 1) * (len(y) + 1) + STEP_CELLS * (len(x) + len(y))):
            yield group
            group, new_h, new_w = [], len(x) + 1, len(y) + 1
        group.append((x, y))
        h, w = new_h, new_w
    if group:
        yield group


ALIGNMENT = StructType([StructField("score", IntegerType()), StructField("cigar", StringType()), StructField("different", IntegerType()), StructField("sites", IntegerType())])


def aligned(pairs: DataFrame, aligner: str = "affine", a: str = "a", b: str = "b", name: str = "alignment", max_score: int | None = None, slack: int | None = None) -> DataFrame:
    """``pairs`` with a struct (score, cigar, different, sites) of columns ``a`` and ``b``; null where either is null.

    With ``max_score``, null too where the score is above it, and the work ends there; with ``slack``, cells that lag are
    given up and the score may not be the best (see ``align_batch``).

    Pairs are aligned in groups of like size whose dynamic programs fit CELLS cells; a longer pair is a group of its own, of
    which parts are held. Equal pairs of a batch are aligned once.
    """
    scoring = SCORINGS[aligner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            told: dict[tuple[str, str], dict | None] = {}
            for part in like_sizes({p for p in zip(left, right, strict=True) if p[0] is not None and p[1] is not None}, in_bytes(scoring, max_score, slack)):
                scores, paths = align_batch([x for x, _ in part], [y for _, y in part], scoring, max_score, slack)
                for (x, y), score, path in zip(part, scores, paths, strict=True):
                    different, sites = site_counts(x, y, path) if score is not None else (0, 0)
                    told[x, y] = None if score is None else {"score": score, "cigar": run_lengths(path), "different": different, "sites": sites}
            out = [told.get(p) for p in zip(left, right, strict=True)]
            kind = pa.struct([("score", pa.int32()), ("cigar", pa.string()), ("different", pa.int32()), ("sites", pa.int32())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=kind)], names=[*batch.schema.names, name])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField(name, ALIGNMENT)]))


def side_by_side(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Differing and comparable sites of each two sequences laid side by side, all in one comparison."""
    n = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    u, v = (np.frombuffer("".join(x[:k] for x, k in zip(s, n.tolist(), strict=True)).encode("ascii", "replace"), np.uint8) for s in (a, b))
    known = (u != b"N"[0]) & (v != b"N"[0])
    ends, out = np.cumsum(n), []
    for mask in ((u != v) & known, known):
        total = np.concatenate([[0], np.cumsum(mask)])
        out.append(total[ends] - total[ends - n])
    return out[0], out[1]


@F.pandas_udf(StructType([StructField("different", IntegerType()), StructField("sites", IntegerType())]))
def ungapped_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Differing and comparable sites of two sequences laid side by side from their first letters on; a null one has none."""
    different, sites = side_by_side(a.fillna("").tolist(), b.fillna("").tolist())
    return pd.DataFrame({"different": different, "sites": sites})


__all__ = ["ALIGNMENT", "SCORINGS", "Scoring", "align_batch", "aligned", "run_lengths", "side_by_side", "site_counts", "ungapped_counts"]
