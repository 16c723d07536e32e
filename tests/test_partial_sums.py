"""Sums that are made where the rows are, against plain counts."""

import random
from collections import Counter

import pytest

from cladeforge.functions import table_functions as T
from cladeforge.operators import likelihood


@pytest.mark.parametrize("most", [1000, 1])
def test_seed_totals_equal_counted_seeds(monkeypatch, most):
    monkeypatch.setattr(T, "MAX_GROUPS", most)
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), "".join(rng.choices("ACGTN", k=rng.randrange(40)))) for _ in range(60)] + [("x", None), (None, "ACGTACGT")]
    told, plain = T.SeedTotals.func(), T.SpacedSeeds.func()
    parts = [r for row in rows for r in told.eval(row)] + list(told.terminate())
    n, place, want, first = Counter(), {}, Counter(), {}
    for g, code, count, at in parts:
        n[g, code] += count
        place[g, code] = min(place.get((g, code), at), at)
    for g, seq in rows:
        for code, at in plain.eval(seq):
            want[g, code] += 1
            first[g, code] = min(first.get((g, code), at), at)
    assert n == want and place == first
    assert most == 1 or len(parts) == len(want)


@pytest.mark.parametrize("small", [1 << 16, 1])
def test_patterns_are_counted_as_numbers(spark, monkeypatch, small):
    monkeypatch.setattr(likelihood, "SMALL", small)
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGTN-", k=rng.randrange(30))) for _ in range(50)] + [None]
    fixed = ["ACGTN", "", "GGG-CCCTTTA"]
    got = {r.pattern: r.n for r in likelihood.patterns_against(spark.createDataFrame([(s,) for s in seqs], "seq string"), fixed).collect()}
    plain = lambda s, k: (s[k] if k < len(s) else "N").replace("-", "N")
    assert got == Counter("".join(plain(f, k) for f in (*fixed, s)) for s in seqs if s for k in range(len(s)))
    with pytest.raises(ValueError):
        likelihood.patterns_against(spark.createDataFrame([("A",)], "seq string"), ["A"] * 26)
