"""Global affine alignment (mismatch 4, gap of n 6 + 2 n) of many pairs at once, a bit of 64 pairs in a word.

Half costs are held, as differences from cell to cell less the cost of extending (``alignment._forward``): with those a cell is
0 to 2 below the one on its diagonal, a difference is -5 to 3 and a gap 0 to 3 above its cell. So each number is two to four arrays of
bits, and a step of an antidiagonal is some 70 operations on words.

No moves are held on the way forward, but the states of each BLOCK-th antidiagonal. On the way back the moves of a pair are made
again from the state before, only for the triangle of cells that its way can cross up to there; all pairs take a block at a time.
"""

from __future__ import annotations

import math

import numpy as np

#: Antidiagonals between two held states; cells of an antidiagonal in one array, and those from which on bits are faster than bytes.
BLOCK, WIDE, NARROW = 64, 1 << 19, 100_000
#: Cells of a pair from which on bits are faster: of smaller ones the way back takes longer than the way forward.
LARGE = 1 << 19
#: Cells that take as long as one antidiagonal takes however few its pairs.
STEP_CELLS = 100_000
#: Half of what opening a gap costs, pairs in a word, where a way back stops, and steps after which it is seen whether all have.
OPENING, WORD, STOP, CHECKED = 3, 64, 255, 16


def parts(able: np.ndarray, n: np.ndarray, m: np.ndarray, like: float, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs of like size in parts that fill up WIDE, whose states fit ``most`` bytes; and those that are too few, or too small, for bits."""
    out, left, part, h, w = [], [], [], 0, 0

    def end() -> None:
        if part:
            (out if len(part) * min(h, w) >= NARROW and h * w >= LARGE and held_cells(len(part), h, w) * 2 <= most else left).append(np.array(part))

    kind = np.floor(np.log(np.maximum(n[able], 1)) / math.log(like))
    for k in able[np.lexsort((n[able], m[able], kind))].tolist():
        x, y = int(n[k]), int(m[k])
        new_h, new_w = max(h, x), max(w, y)
        full = len(part) % WORD == 0 and ((len(part) + WORD) * min(new_h, new_w) > WIDE or held_cells(len(part) + WORD, new_h, new_w) * 2 > most)
        if part and (full or new_h * new_w * (len(part) + 1) - h * w * len(part) > x * y + STEP_CELLS * (x + y)):
            end()
            part, new_h, new_w = [], x, y
        part.append(k)
        h, w = new_h, new_w
    end()
    return out, np.concatenate(left) if left else np.zeros(0, dtype=np.int64)


def held_cells(size: int, height: int, width: int) -> int:
    """Cells of the states that are held of ``size`` pairs."""
    return ((height + width) // BLOCK + 1) * min(height, width) * -(-size // WORD) * WORD


def _planes(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Codes (place, lane) as words of one bit of each lane, place after place."""
    return [np.packbits(codes >> b & 1, axis=1, bitorder="little").view(np.uint64).ravel() for b in range(bits)]


def _coded(rows: list[str], height: int, lanes: int, number: np.ndarray) -> np.ndarray:
    out = np.zeros((height, lanes), dtype=np.uint8)
    for k, r in enumerate(rows):
        out[: len(r), k] = number[np.frombuffer(r.encode("ascii", "replace"), dtype=np.uint8)]
    return out


def _kept(planes: list[np.ndarray], low: int, high: int, words: int, out: np.ndarray) -> None:
    """Eight planes of some places at most, as a byte a cell."""
    out = out.view(np.uint64)  # bytes are 0 or 1, so eight are moved at once
    out[:] = 0
    for b, plane in enumerate(planes):
        bit = np.unpackbits(plane[low * words : (high + 1) * words].view(np.uint8), bitorder="little").view(np.uint64)
        out |= np.left_shift(bit, np.uint64(b), out=bit)


def _forward(x: np.ndarray, y: np.ndarray, bits: int, held: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """States of each BLOCK-th antidiagonal into ``held``, one after the other, and the first place of each into ``lows``; where each begins.

    Of a state one row of ``held`` has the differences across and down (four bits each), the other what gaps down and along cost.

    Sequences are codes (place, lane) of ``bits`` bits. Differences are held as they are on even antidiagonals, negated on odd
    ones: the negative of a new difference is the other one's plus what the cell is below the diagonal.
    """
    (height, lanes), width = x.shape, len(y)
    words, total = lanes // WORD, height + width
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    px = _planes(x, bits)
    py = [~p for p in _planes(np.ascontiguousarray(y[::-1]), bits)]  # so that like letters are all ones
    new = lambda: np.zeros((height + 2) * words, dtype=np.uint64)
    u, v, v_new, g, r = [new() for _ in range(4)], [new() for _ in range(4)], [new() for _ in range(4)], [new() for _ in range(2)], [new() for _ in range(2)]
    for z in (*g, *r):
        z[:] = every
    # (0, 1) and (1, 0) are one opening above (0, 0), as all edges begin; that antidiagonal is odd
    minus_three = (1, 0, 1, 1)
    for b in range(4):
        if minus_three[b]:
            u[b][:words] = v[b][words : 2 * words] = every
    most = min(height, width) * words
    temp = [np.empty(most, dtype=np.uint64) for _ in range(16)]
    begins, at = np.zeros(total // BLOCK + 1, dtype=np.int64), 0
    xor, both, either = np.bitwise_xor, np.bitwise_and, np.bitwise_or
    for d in range(2, total + 1):
        low, high = max(1, d - width), min(height, d - 1)
        here, above = slice(low * words, (high + 1) * words), slice((low - 1) * words, high * words)
        k = (high - low + 1) * words
        p0, p1, p2, p3, q0, q1, q2, q3, c, t, s, z1, z2, a, e, like = (z[:k] for z in temp)
        back = slice((width - d + low) * words, (width - d + high + 1) * words)
        xor(px[0][above], py[0][back], like)
        for b in range(1, bits):
            xor(px[b][above], py[b][back], t)
            both(like, t, like)
        even = d & 1  # of the antidiagonal before
        for (n0, n1, n2, n3), (g0, g1), (o0, o1, o2, o3) in (([z[above] for z in u], [z[above] for z in g], (p0, p1, p2, p3)), ([z[here] for z in v], [z[here] for z in r], (q0, q1, q2, q3))):
            # a gap's cost above the diagonal: gap + difference (gap - negated difference)
            xor(g0, n0, o0)
            both(n0, g0 if even else o0, c)
            xor(g1, n1, t)
            xor(t, c, o1)
            both(n1, g1 if even else t, s)
            both(c, t if even else o1, t)
            either(s, t, c)
            xor(n2, c, o2)
            (both if even else either)(n2, c, c)
            xor(n3, c, o3)
        # how far the cell is below the diagonal: 2 (a match, or a gap) or 1 (a gap)
        both(p3, p0, a)
        xor(p3, a, t)
        both(q3, q0, e)
        xor(q3, e, s)
        either(like, t, z2)
        either(z2, s, z2)
        either(a, e, a)
        both(a, z2, t)
        xor(a, t, z1)
        for (n0, n1, n2, n3), (o0, o1, o2, o3) in (([z[above] for z in u], [z[here] for z in v_new]), ([z[here] for z in v], [z[here] for z in u])):
            # the other difference, negated: plus (minus, where it is negated already) what the cell is below
            xor(n0, z1, o0)
            both(z1, n0 if even else o0, c)
            either(c, z2, c)
            xor(n1, c, o1)
            both(c, n1 if even else o1, c)
            xor(n2, c, o2)
            both(c, n2 if even else o2, c)
            xor(n3, c, o3)
        for (o0, o1, o2, o3), (g0, g1) in (((p0, p1, p2, p3), [z[here] for z in g]), ((q0, q1, q2, q3), [z[here] for z in r])):
            # what the gap costs above the cell, an opening at most
            both(o0, z1, c)
            either(c, z2, c)
            both(o1, c, t)
            xor(o2, t, t)
            xor(o2, o3, s)
            either(t, s, t)
            xor(o0, z1, o0)
            either(o0, t, g0)
            xor(o1, c, o1)
            either(o1, t, g1)
        v, v_new = v_new, v
        if d == 2:
            for z in u:
                z[:words] = 0
            for z in v_new:
                z[words : 2 * words] = 0
        if d % BLOCK == 0:
            size = (high - low + 1) * lanes
            begins[d // BLOCK], lows[d // BLOCK] = at, low
            _kept([*u, *v], low, high, words, held[0, at : at + size])
            _kept([*g, *r], low, high, words, held[1, at : at + size])
            at += size
    return begins


def align(a: list[str], b: list[str], groups: list[np.ndarray], room: np.ndarray, steps: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ways back of all pairs (a step a column, 0 where there is none), and where in both sequences each begins.

    ``groups``: pairs that go forward together; ``room``: two rows of bytes for their states (``held_cells``). ``steps`` and
    ``after``: step taken and next state, by state * 256 + move.
    """
    size, number = len(a), np.zeros(256, dtype=np.uint8)
    letters = sorted(set().union(*map(set, a), *map(set, b)))
    codes = np.frombuffer("".join(letters).encode("ascii", "replace"), dtype=np.uint8)
    number[codes] = np.arange(len(codes))
    bits = max(int(len(letters) - 1).bit_length(), 1)
    n, m = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    blocks = (int(n.max()) + int(m.max())) // BLOCK + 1
    begins, lows = (np.zeros((len(groups), blocks), dtype=np.int64) for _ in range(2))
    group, stride, lane, first_x, first_y = (np.zeros(size, dtype=np.int64) for _ in range(5))
    xs, ys, at_x, at_y, used = [], [], 0, 0, 0
    for k, p in enumerate(groups):
        h, w, lanes = int(n[p].max()), int(m[p].max()), -(-len(p) // WORD) * WORD
        x, y = _coded([a[i] for i in p], h, lanes, number), _coded([b[i] for i in p], w, lanes, number)
        cells = held_cells(len(p), h, w)
        told = _forward(x, y, bits, room[:, used : used + cells], lows[k])
        begins[k, : len(told)] = told + used
        used += cells
        group[p], stride[p], lane[p], first_x[p], first_y[p] = k, lanes, np.arange(len(p)), at_x, at_y
        xs.append(x.ravel())
        ys.append(y.ravel())
        at_x, at_y = at_x + x.size, at_y + y.size
    x, y = np.concatenate(xs), np.concatenate(ys)
    i, j, state = n.copy(), m.copy(), np.zeros(size, dtype=np.int64)
    # a block ends, or an edge is met, in the state that was
    after = after.copy()
    after[STOP::256] = np.arange(3) << 8
    trail = []
    while True:
        live = np.flatnonzero((i > 0) & (j > 0))
        if not len(live):
            return np.concatenate(trail, axis=1) if trail else np.zeros((size, 0), dtype=np.uint8), i, j
        block = (i[live] + j[live] - 1) // BLOCK
        start = block * BLOCK
        flat = _again(x, y, room, begins[group[live], block], lows[group[live], block], stride[live], lane[live], first_x[live], first_y[live], i[live], start).ravel()
        across = len(live)
        layer = (BLOCK + 1) * across
        back = np.array([0, 2 * layer + across, layer + across, layer])[steps]
        place, now, keys = (i[live] + j[live] - start + 1) * layer + BLOCK * across + np.arange(across), state[live], []
        while len(keys) < BLOCK:
            key = flat.take(place)
            key = now + key
            now = after.take(key)
            place -= back.take(key)
            keys.append(key)
            if len(keys) % CHECKED == 0 and (key & 255 == STOP).all():
                break
        way = steps.astype(np.uint8).take(np.stack(keys, axis=1))
        trail.append(np.zeros((size, len(keys)), dtype=np.uint8))
        trail[-1][live] = way
        i[live] -= ((way == 1) | (way == 2)).sum(axis=1)
        j[live] -= ((way == 1) | (way == 3)).sum(axis=1)
        state[live] = now


def _again(x: np.ndarray, y: np.ndarray, held: np.ndarray, begin: np.ndarray, low: np.ndarray, stride: np.ndarray, lane: np.ndarray, first_x: np.ndarray, first_y: np.ndarray, i: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Moves (antidiagonal from ``start`` - 1 on, place from ``i`` - BLOCK on, pair) of a block, as ``alignment._steps`` reads them.

    Those in the triangle below ``i`` are right; those before the block and on the edges are STOP.
    """
    size, rows = len(i), BLOCK + 1
    place = (i - BLOCK)[None, :] + np.arange(rows)[:, None]
    top = i - BLOCK
    at = begin + np.maximum(place - low, 0) * stride + lane
    state, gaps = held[0].take(at, mode="clip"), held[1].take(at, mode="clip").view(np.int8)
    signed = lambda z: (z ^ 8).view(np.int8) - np.int8(8)
    across, down, gap_down, gap_right = signed(state & 15), signed(state >> 4), gaps & 3, gaps >> 2
    mine = x.take(first_x + np.maximum(place - 1, 0) * stride + lane, mode="clip")
    other = y.take(first_y + np.maximum(start - top - 1 - np.arange(BLOCK)[:, None], 0) * stride + lane, mode="clip")
    lanes = np.arange(size)
    moves = np.empty((BLOCK + 2, rows, size), dtype=np.uint8)
    moves[:2] = STOP
    signed_moves = moves.view(np.int8)
    new_down = np.empty_like(down)
    z_, p_, q_, s_ = (np.empty((rows, size), dtype=np.int8) for _ in range(4))
    at_top, at_side = lanes[top <= 0], lanes[(start <= i)]

    def edges(t: int) -> None:
        # of the first row and column: an opening at their first cells, no cost more after that
        d = start + t
        if len(at_top):
            row = -top[at_top]
            across[row, at_top], gap_down[row, at_top] = np.where(d[at_top] == 1, OPENING, 0), OPENING
            moves[t + 1, row, at_top] = STOP
        if len(at_side):
            row = (d - top)[at_side]
            inside = row <= BLOCK
            row, of = row[inside], at_side[inside]
            down[row, of], gap_right[row, of] = np.where(d[of] == 1, OPENING, 0), OPENING
            moves[t + 1, row, of] = STOP

    edges(0)
    for t in range(1, BLOCK + 1):
        here, above, k = slice(t, rows), slice(t - 1, rows - 1), rows - t
        z, p, q, s = z_[:k], p_[:k], q_[:k], s_[:k]
        np.equal(mine[here], other[:k], out=s.view(bool))
        np.multiply(s, np.int8(-2), out=s)
        np.add(gap_down[above], across[above], out=p)
        np.add(gap_right[here], down[here], out=q)
        np.minimum(p, q, out=z)
        np.minimum(z, s, out=z)
        np.subtract(z, across[above], out=new_down[here])
        np.subtract(z, down[here], out=across[here])
        np.subtract(p, z, out=p)
        np.subtract(q, z, out=q)
        np.minimum(p, np.int8(OPENING), out=gap_down[here])
        np.minimum(q, np.int8(OPENING), out=gap_right[here])
        f = signed_moves[t + 1, here]
        np.multiply(gap_right[here], np.int8(8), out=f)
        np.add(f, gap_down[here], out=f)
        np.not_equal(s, z, out=s.view(bool))
        np.multiply(s, np.int8(64), out=s)
        np.add(f, s, out=f)
        down, new_down = new_down, down
        edges(t)
    return moves
