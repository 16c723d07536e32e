"""Alignment in bytes against the program that holds costs, and the tasks that it is dealt to."""

import random

import pytest

from cladeforge.functions import alignment as A
from cladeforge.operators import clusters


def some(rng, n, most):
    root = "".join(rng.choices("ACGT", k=most))
    near = ["".join(rng.choice("ACGTN") if rng.random() < 0.2 else c for c in root[rng.randrange(9) : rng.randrange(10, most)]) for _ in range(n)]
    return ["", "", "A", "ACGT" * 50, *near, *("".join(rng.choices("ACGTN", k=rng.randrange(most))) for _ in range(n))]


@pytest.mark.parametrize("name", ["affine", "nw"])
@pytest.mark.parametrize("cached", [1, 65_536])
def test_bytes_give_what_costs_give(name, cached, monkeypatch):
    monkeypatch.setattr(A, "CACHED", cached)
    rng = random.Random(5)
    a, b = some(rng, 60, 90), some(rng, 60, 120)
    rng.shuffle(b)
    a += ["", "C"]
    b += ["", "C"]
    fast = A._by_differences(a, b, A.SCORINGS[name])
    assert fast == A.align_batch(a, b, A.SCORINGS[name])
    # where moves don't fit CELLS, costs are held
    monkeypatch.setattr(A, "CELLS", 1)
    monkeypatch.setattr(A, "_by_differences", None)
    for k in range(0, len(a), 5):
        assert A.align_batch(a[k : k + 1], b[k : k + 1], A.SCORINGS[name]) == ([fast[0][k]], [fast[1][k]])


def test_tasks_follow_the_letters(spark, monkeypatch):
    rows = spark.range(64).selectExpr("id AS seq_id", "repeat('ACGT', 16) AS seq")
    monkeypatch.setattr(clusters, "TASK_LETTERS", 256, raising=False)
    assert clusters.dealt(rows, rows.select("seq_id")).rdd.getNumPartitions() == 16
