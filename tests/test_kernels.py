"""Alignment, trees, alignments of many and likelihood against naive versions."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest

from cladeforge.functions import alignment as A
from cladeforge.operators import alignments as M
from cladeforge.operators import likelihood as L
from cladeforge.operators import trees as T


def naive_score(a, b, s):
    far = 1 << 28
    n, m = len(a), len(b)
    h, e, f = ([[far] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    h[0][0] = 0
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        if i:
            f[i][j] = min(h[i - 1][j] + s.opening, f[i - 1][j]) + s.extending
        if j:
            e[i][j] = min(h[i][j - 1] + s.opening, e[i][j - 1]) + s.extending
        if i or j:
            d = h[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch) if i and j else far
            h[i][j] = 0 if s.free_ends and not (i and j) else min(d, e[i][j], f[i][j])
    return s.sign * (min(min(h[n]), min(r[m] for r in h)) if s.free_ends else h[n][m])


def path_score(path, s):
    if s.free_ends:
        path = re.sub("^[ID]+|[ID]+$", "", path)
    return s.sign * sum({"M": s.match * len(g[0]), "X": s.mismatch * len(g[0])}.get(g[0][0], s.opening + s.extending * len(g[0])) for g in re.finditer("M+|X+|I+|D+", path))


@pytest.mark.parametrize("name", list(A.SCORINGS))
def test_scores_and_paths(name):
    rng, s = random.Random(1), A.SCORINGS[name]
    word = lambda: "".join(rng.choices("ACGTN", k=rng.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(300)]
    pairs += [(a, "".join(c for c in a if rng.random() > 0.2)) for a, _ in pairs[:100]]
    scores, paths = A.align_batch([a for a, _ in pairs], [b for _, b in pairs], s)
    for (a, b), score, path in zip(pairs, scores, paths, strict=True):
        assert score == naive_score(a, b, s) == path_score(path, s)
        assert (sum(c != "I" for c in path), sum(c != "D" for c in path)) == (len(a), len(b))


def test_known_costs():
    score = lambda a, b, k: int(A.align_batch([a], [b], A.SCORINGS[k])[0][0])
    assert [score(a, b, "affine") for a, b in (("ACGT", "ACGT"), ("ACGT", "AGGT"), ("ACGT", "ACT"), ("ACGGT", "ACT"))] == [0, 4, 8, 10]
    assert score("ACGT", "ACGT", "nw") == 8 and score("ACGTAA", "ACGT", "nw") == 8


def test_site_counts_leave_out_n_and_gaps():
    assert A.site_counts("ACNGT", "ACGT", "MMDMM") == (0, 4)
    assert A.site_counts("ACNT", "ATGT", "MXXM") == (1, 3)
    assert A.run_lengths("MMXDD") == "2M1X2D" and A.run_lengths("") == ""


def distances_on(parent, length, leaves):
    up = lambda x: [] if x < 0 else [x, *up(parent[x])]
    out = np.zeros((leaves, leaves))
    for i, j in itertools.product(range(leaves), repeat=2):
        out[i, j] = sum(length[x] for x in set(up(i)) ^ set(up(j)))
    return out


def test_neighbour_joining_recovers_additive_distances():
    d = np.array([[0, 3, 5, 6], [3, 0, 6, 7], [5, 6, 0, 7], [6, 7, 7, 0]], float)
    parent, length = T.join_neighbours(d)
    assert np.allclose(distances_on(parent, length, 4), d) and parent[6] == -1
    rng = np.random.default_rng(2)
    for n in (2, 3, 9, 25):
        parent = np.full(2 * n - 1, -1)
        nodes = list(range(n))
        for new in range(n, 2 * n - 1):
            for _ in range(2):
                parent[nodes.pop(rng.integers(len(nodes)))] = new
            nodes.append(new)
        d = distances_on(parent, rng.uniform(0.1, 1, 2 * n - 1), n)
        got = T.join_neighbours(d)
        assert np.allclose(distances_on(*got, n), d)
        mid_parent, mid_length = T.rooted_at_midpoint(*got, n)
        assert np.allclose(distances_on(mid_parent, mid_length, n), d)
        if n > 2:
            i, j = np.unravel_index(d.argmax(), d.shape)
            rows = T.described(0, mid_parent, mid_length, np.arange(n))
            assert abs(rows["dist_root"][i] - d.max() / 2) < 1e-9 and abs(rows["dist_root"][j] - d.max() / 2) < 1e-9
            assert rows["nd"].iloc[-1] == n and (rows["depth"] > 0).sum() == 2 * n - 2


def test_alignment_of_many_keeps_each_sequence():
    rng = random.Random(3)
    base = "".join(rng.choices("ACGT", k=150))
    seqs = []
    for _ in range(9):
        s = [c for c in base if rng.random() > 0.04]
        seqs.append("".join(rng.choice("ACGT") if rng.random() < 0.05 else c for c in s))
    rows = M.align_cluster(seqs)
    assert len({len(r) for r in rows}) == 1
    assert ["".join("ACGTN-"[c] for c in r).replace("-", "") for r in rows] == seqs
    assert rows.shape[1] < 185
    assert M.align_cluster(["ACGT"]).tolist() == [[0, 1, 2, 3]]


def test_transitions_and_pruning_against_sums_over_states():
    rng = np.random.default_rng(4)
    params = rng.uniform(0.3, 3, 8)
    pi, q = L.model(params)
    assert np.allclose(q.sum(axis=1), 0) and np.allclose(pi @ q, 0)
    p = L.transitions(params, np.array([0.0, 0.3, 50.0]))
    assert np.allclose(p[0], np.eye(4)) and np.allclose(p.sum(axis=2), 1) and np.allclose(p[2], pi, atol=1e-6)
    parent, length = np.array([4, 4, 5, 5, 6, 6, -1]), rng.uniform(0.05, 1, 7)
    p = L.transitions(params, length)
    codes = rng.integers(0, 5, (4, 6))
    tips = np.concatenate([np.eye(4), np.ones((1, 4))])[codes]
    expected = 0.0
    for site in range(6):
        total = 0.0
        for x, y, r in itertools.product(range(4), repeat=3):
            leaves = [tips[k, site] for k in range(4)]
            total += pi[r] * p[4][r, x] * p[5][r, y] * (p[0][x] @ leaves[0]) * (p[1][x] @ leaves[1]) * (p[2][y] @ leaves[2]) * (p[3][y] @ leaves[3])
        expected += np.log(total)
    order = L.order_of(parent)
    assert abs(L.log_likelihood(parent, order, tips, np.ones(6), params, length) - expected) < 1e-9


def test_root_of_simulated_sequences():
    rng = np.random.default_rng(5)
    n = 12
    d = np.zeros((n, n))
    root = rng.integers(0, 4, 300)
    params = np.array([1.2, 0.8, 1.0, 1, 3, 1, 1, 3.0])
    leaves = []
    for k in range(n):
        t = L.transitions(params, np.array([0.04]))[0]
        leaves.append(np.array([rng.choice(4, p=t[c] / t[c].sum()) for c in root]))
    codes = np.stack(leaves)
    for i, j in itertools.product(range(n), repeat=2):
        d[i, j] = (codes[i] != codes[j]).mean() if i != j else 0
    parent, length = T.rooted_at_midpoint(*T.join_neighbours(d), n)
    seq, value, fitted = L.root_sequence(codes, parent, length)
    truth = "".join("ACGT"[c] for c in root)
    assert sum(a == b for a, b in zip(seq, truth, strict=True)) > 285
    assert value > L.log_likelihood(parent, L.order_of(parent), np.eye(4)[codes], np.ones(300), np.ones(8), np.clip(length, 1e-5, 2)) and len(fitted) == 8


def _pairs(n, longest, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("ACGTN", k=rng.randint(0, longest)))
    left = [word() for _ in range(n)]
    return left, [word() if k % 2 else "".join(c for c in a if rng.random() > 0.1) for k, a in enumerate(left)]


@pytest.mark.parametrize("name", list(A.SCORINGS))
def test_moves_made_again_in_blocks(name, monkeypatch):
    left, right = _pairs(60, 25, 5)
    wanted = A.align_batch(left, right, A.SCORINGS[name])
    for cells in (1, 3000, 20_000):
        monkeypatch.setattr(A, "CELLS", cells)
        assert A.align_batch(left, right, A.SCORINGS[name]) == wanted


@pytest.mark.parametrize("name", ["affine", "linear", "edit"])
def test_score_cap_and_slack(name):
    left, right = _pairs(80, 25, 6)
    scores, paths = A.align_batch(left, right, A.SCORINGS[name])
    for cap in (0, 7, 25, 60):
        capped, short = A.align_batch(left, right, A.SCORINGS[name], cap=cap)
        assert capped == [s if s <= cap else None for s in scores]
        assert [p for p, s in zip(short, scores, strict=True) if s <= cap] == [p for p, s in zip(paths, scores, strict=True) if s <= cap]
    lax, _ = A.align_batch(left, right, A.SCORINGS[name], slack=1000)
    tight, ways = A.align_batch(left, right, A.SCORINGS[name], slack=12)
    assert lax == scores and all(t >= s for t, s in zip(tight, scores, strict=True) if t is not None)
    assert all(path_score(w, A.SCORINGS[name]) == t for w, t in zip(ways, tight, strict=True) if t is not None)
    with pytest.raises(ValueError):
        A.align_batch(left, right, A.SCORINGS["nw"], cap=3)


def test_long_pairs_take_little_memory():
    rng = random.Random(7)
    long = "".join(rng.choices("ACGT", k=12_000))
    near = "".join(c if rng.random() > 0.01 else "" for c in long)
    tracemalloc.start()
    scores, paths = A.align_batch([long], [near], A.SCORINGS["affine"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and path_score(paths[0], A.SCORINGS["affine"]) == scores[0]


def test_joining_in_place_against_rebuilt_matrices():
    rng = np.random.default_rng(8)
    d = rng.random((40, 40))
    d = np.triu(d, 1) + np.triu(d, 1).T
    parent, length = T.join_neighbours(d)
    # the same by the definition, with the whole matrix made anew at each join
    at = {k: {m: d[k, m] for m in range(40)} for k in range(40)}
    for new in range(40, 78):
        k, r = len(at), {x: sum(row.values()) for x, row in at.items()}
        _, i, j = min((at[x][y] - (r[x] + r[y]) / (k - 2), x, y) for x in at for y in at if x < y)
        assert parent[i] == parent[j] == new
        first = (at[i][j] + (r[i] - r[j]) / (k - 2)) / 2
        assert np.allclose(length[[i, j]], np.maximum([first, at[i][j] - first], T.MIN_BRANCH))
        row = {x: (at[i][x] + at[j][x] - at[i][j]) / 2 for x in at if x not in (i, j)}
        at = {x: {**{y: v for y, v in at[x].items() if y not in (i, j)}, new: row[x]} for x in row} | {new: {**row, new: 0.0}}
    s = rng.integers(0, 5, (30, 30))
    s = np.triu(s, 1) + np.triu(s, 1).T
    tree, at = T.upgma(s), {k: {m: float(s[k, m]) for m in range(30)} for k in range(30)}
    for new in range(30, 59):
        _, i, j = min((-at[x][y], x, y) for x in at for y in at if x < y)
        assert tree[i] == tree[j] == new
        row = {x: (at[i][x] + at[j][x]) / 2 for x in at if x not in (i, j)}
        at = {x: {**{y: v for y, v in at[x].items() if y not in (i, j)}, new: row[x]} for x in row} | {new: {**row, new: 0.0}}


def test_profile_moves_made_again(monkeypatch):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 6, (3, 40)), rng.integers(0, 6, (2, 55))
    wanted = M.align_profiles(a, b)
    assert ((wanted != 2).sum(), (wanted != 1).sum()) == (40, 55)
    for moves in (1, 200, 1000):
        monkeypatch.setattr(M, "MOVES", moves)
        assert (M.align_profiles(a, b) == wanted).all()


def test_guide_tree_of_many_splits_families_apart():
    rng = random.Random(10)
    base = ["".join(rng.choices("ACGT", k=300)) for _ in range(2)]
    seqs = ["".join(c if rng.random() > 0.03 else rng.choice("ACGT") for c in base[k % 2]) for k in range(130)]
    parent = M.guide_tree([M.coded(s) for s in seqs])
    n = len(seqs)
    assert sorted(np.bincount(parent[parent >= 0], minlength=2 * n - 1)[n:].tolist()) == [2] * (n - 1) and (parent[:-1] > np.arange(2 * n - 2)).all()
    leaves = {x: {x} for x in range(n)}
    for x in range(2 * n - 2):
        leaves.setdefault(int(parent[x]), set()).update(leaves[x])
    top = [leaves[x] for x in range(2 * n - 2) if parent[x] == 2 * n - 2]
    assert sorted({k % 2 for k in side} for side in top) == [{0}, {1}]
    same = M.guide_tree([M.coded(base[0])] * 120)
    assert (same[:-1] > np.arange(238)).all()
    rows = M.align_cluster(seqs)
    assert ["".join(chr(M.LETTERS[c]) for c in r if c != 5) for r in rows] == seqs


def test_fit_settles():
    rng = random.Random(11)
    root = "".join(rng.choices("ACGT", k=200))
    rows = np.stack([M.coded("".join(c if rng.random() > 0.1 else rng.choice("ACGT") for c in root)) for _ in range(6)])
    d = np.array([[(x != y).mean() for y in rows] for x in rows])
    tree = T.rooted_at_midpoint(*T.join_neighbours(d), 6)
    _, value, _ = L.root_sequence(rows, *tree)
    L_ROUNDS, L.ROUNDS = L.ROUNDS, 40
    again = L.root_sequence(rows, *tree)[1]
    L.ROUNDS = L_ROUNDS
    assert abs(again - value) < 0.05
