"""Two-piece gap costs against the plain five-state program, whole and with moves made again in blocks."""

import random
import re

import pytest

from cladeforge.functions import alignment
from cladeforge.functions.alignment import SCORINGS, align_batch

FAR = 10**9


def least_cost(a, b):
    """The cost by the definition: any gap of n may take 6 + 2 n or 24 + n."""
    gap = lambda n: min(6 + 2 * n, 24 + n)
    best = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [best.get((i, j), FAR)]
            if i and j:
                options.append(best[i - 1, j - 1] + 4 * (a[i - 1] != b[j - 1]))
            options += [best[i - n, j] + gap(n) for n in range(1, i + 1)]
            options += [best[i, j - n] + gap(n) for n in range(1, j + 1)]
            best[i, j] = min(options)
    return best[len(a), len(b)]


def cost_of(path):
    return sum({"M": 0, "X": 4 * len(g[0])}.get(g[0][0], min(6 + 2 * len(g[0]), 24 + len(g[0]))) for g in re.finditer("M+|X+|I+|D+", path))


def pairs(seed, n, most):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = "".join(rng.choices("ACGT", k=rng.randint(0, most)))
        cut = rng.randint(0, len(a))
        insert = "".join(rng.choices("ACGT", k=rng.choice([0, 3, 25, 40])))
        b = "".join(c if rng.random() > 0.05 else "G" for c in a[:cut]) + insert + a[cut + rng.choice([0, 0, 2, 30]) :]
        out.append((a, b))
    return out


@pytest.mark.parametrize("cells", [96_000_000, 3_000])
def test_scores_and_paths(monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    made = pairs(1, 24, 60)
    scores, paths = align_batch([a for a, _ in made], [b for _, b in made], SCORINGS["affine2"])
    one, _ = align_batch([a for a, _ in made], [b for _, b in made], SCORINGS["affine"])
    assert any(x < y for x, y in zip(scores, one, strict=True))
    for (a, b), score, path in zip(made, scores, paths, strict=True):
        assert score == least_cost(a, b) == cost_of(path)
        assert (sum(c != "I" for c in path), sum(c != "D" for c in path)) == (len(a), len(b))


def test_cap_and_slack():
    made = pairs(2, 16, 50)
    left, right = [a for a, _ in made], [b for _, b in made]
    scores, _ = align_batch(left, right, SCORINGS["affine2"])
    cap = sorted(scores)[8]
    capped, _ = align_batch(left, right, SCORINGS["affine2"], cap)
    assert capped == [s if s <= cap else None for s in scores]
    assert align_batch(left, right, SCORINGS["affine2"], None, 10_000)[0] == scores


def test_free_ends_have_one_piece():
    with pytest.raises(ValueError, match="global"):
        align_batch(["A"], ["C"], alignment.Scoring(free_ends=True, second=(24, 1)))
