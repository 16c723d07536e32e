"""Seed matches against a few sequences are counted without listing them, so their number doesn't make the work."""

import random

import numpy as np
import pytest

from cladeforge.functions import seeds
from cladeforge.functions.seeds import SeedTable, coded, seed_matches, seed_table
from cladeforge.operators import distances


@pytest.mark.parametrize("diagonals", [1000, 1 << 25])
def test_table_against_listed_matches(monkeypatch, diagonals):
    """Lengths about the six letters of a seed and the places of a segment; owners all at once, and a few at a time."""
    monkeypatch.setattr(seeds, "DIAGONALS", diagonals)
    rng = random.Random(11)
    some = lambda n: "".join(rng.choices("ACGTN", (4, 1, 1, 3, 1), k=n))
    owners = [some(n) for n in (0, 3, 5, 6, 7, 55, 56, 57, 300, 1500)]
    held, tables = SeedTable(owners), [seed_table(coded(s)) for s in owners]
    for own in [some(n) for n in (0, 5, 6, 55, 56, 57, 107, 700)] + [some(40) + owners[-1][100:900] + some(30)]:
        for least in (0.5, 20.5, 61.08):
            assert held.matches(own, least).tolist() == [seed_matches(seed_table(coded(own)), t, least) for t in tables]


def test_no_match_of_like_letters_is_listed(spark, monkeypatch):
    """Every place matches every place: listed, these would be five times the product of the lengths."""

    def listed(*_):
        raise AssertionError("matches are listed")

    monkeypatch.setattr(distances, "SeedIndex", listed)
    left, right = [(k, "A" * n) for k, n in enumerate((3000, 12, 30))], [(k, "N" * n) for k, n in enumerate((2000, 25))]
    got = distances.seed_similarity(spark.createDataFrame(left, "i long, seq string"), spark.createDataFrame(right, "j long, seq string"))
    expected = {}
    for i, a in left:
        for j, b in right:
            x, y = len(a) - 5, len(b) - 5
            on = np.minimum(np.minimum(np.arange(1, x + y), np.arange(1, x + y)[::-1]), min(x, y)) * 5
            expected[i, j] = int(on[on > distances.LEAST_MATCHES].sum())
    assert {(r.i, r.j): r.similarity for r in got.collect()} == {k: n for k, n in expected.items() if n}
