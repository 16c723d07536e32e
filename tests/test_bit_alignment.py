"""Large pairs are aligned a bit of 64 pairs in a word; results are those by bytes and by costs, whatever the sizes and the block."""

import random

import pytest

from cladeforge.functions import alignment as A
from cladeforge.functions import bit_alignment as B
from cladeforge.operators import clusters


def word(rng, n, letters="ACGTN"):
    return "".join(rng.choices(letters, weights=[9, 3, 2, 8, 9][: len(letters)], k=n))


def some_pairs(rng, low, high, count):
    """Half of them near copies of a part, so that ties and long gaps are met."""
    a = [word(rng, rng.randint(low, high)) for _ in range(count)]
    return a, [word(rng, rng.randint(low, high)) if k % 2 else x[: rng.randint(1, len(x))] + word(rng, rng.randint(0, 9)) for k, x in enumerate(a)]


@pytest.mark.parametrize(("low", "high", "count"), [(1, 6, 70), (1, 200, 130), (61, 67, 64), (100, 300, 65)])
def test_bits_equal_costs(low, high, count, monkeypatch):
    rng = random.Random(low + high)
    a, b = some_pairs(rng, low, high, count)
    wanted = A._by_costs(a, b, A.SCORINGS["affine"], None, None)
    monkeypatch.setattr(B, "NARROW", 1)
    monkeypatch.setattr(B, "LARGE", 1)
    monkeypatch.setattr(A, "_by_differences", None)  # all go by bits
    scores, paths = A.align_batch(a, b, A.SCORINGS["affine"])
    assert scores == wanted[0] and paths == wanted[1]


def test_long_against_short_and_letters_beyond_the_alphabet(monkeypatch):
    monkeypatch.setattr(B, "NARROW", 1)
    monkeypatch.setattr(B, "LARGE", 1)
    rng = random.Random(2)
    a = [word(rng, 900)] * 40 + ["abcdefghijkl" * 3, "A"]
    b = [word(rng, rng.randint(1, 90)) for _ in range(40)] + ["xyzabc-kl", "A" * 500]
    for left, right in ((a, b), (b, a)):
        each = [A._by_costs([x], [y], A.SCORINGS["affine"], None, None) for x, y in zip(left, right, strict=True)]
        assert A.align_batch(left, right, A.SCORINGS["affine"]) == ([s[0] for s, _ in each], [p[0] for _, p in each])


def test_assignment_aligns_many_sequences_with_a_long_root_at_once(spark, monkeypatch):
    """A long root filled up what is held of moves after a few sequences; by bits all of a batch go together."""
    monkeypatch.setattr(A, "CELLS", 40_000)
    monkeypatch.setattr(clusters, "CELLS", 40_000)
    rng = random.Random(6)
    seqs = [word(rng, 60) for _ in range(100)]
    assert [len(p) for p in clusters._like_pairs(seqs, [word(rng, 700)], A.HELD * A.CELLS * B.BLOCK // 2)] == [100]


def test_few_or_small_pairs_go_by_bytes():
    import numpy as np

    n, m = np.array([5000] * 100 + [100] * 500), np.array([2000] * 100 + [100] * 500)
    parts, left = B.parts(np.arange(600), n, m, A.LIKE, A.HELD * A.CELLS)
    assert sorted(np.concatenate(parts).tolist()) == list(range(100)) and sorted(left.tolist()) == list(range(100, 600))
    assert all(B.held_cells(len(p), 5000, 2000) * 2 <= A.HELD * A.CELLS for p in parts)
