"""Alignments are worked on together by their sizes, and sequences dealt to tasks by their lengths."""

import random

import pytest
from pyspark.sql import functions as F

from cladeforge.functions import alignment as A
from cladeforge.operators import clusters


def word(rng, n):
    return "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n))


def of_all_sizes(rng, n):
    return ["", "A", "", "ACGT", *(word(rng, int(2 ** (rng.random() * 8))) for _ in range(n))]


@pytest.mark.parametrize("name", ["affine", "nw"])
def test_a_batch_of_unlike_sizes_is_taken_apart(name, monkeypatch):
    """Long and short pairs together need no program of costs, which all would be filled up for; results are those of each pair by costs."""
    rng = random.Random(3)
    a, b = of_all_sizes(rng, 120), of_all_sizes(rng, 120)
    rng.shuffle(b)
    wanted = [A._by_costs([x], [y], A.SCORINGS[name], None, None) if hasattr(A, "_by_costs") else None for x, y in zip(a, b, strict=True)]
    # a quarter of the filled batch at once, and more than the largest pair
    largest = max((len(x) + 1) * (len(y) + 1) for x, y in zip(a, b, strict=True))
    monkeypatch.setattr(A, "CELLS", largest)
    monkeypatch.setattr(A, "_Program", None)
    scores, paths = A.align_batch(a, b, A.SCORINGS[name])
    assert [([s], [p]) for s, p in zip(scores, paths, strict=True)] == wanted


def test_parts_fit_the_bytes_that_are_held(monkeypatch):
    rng = random.Random(4)
    a, b = of_all_sizes(rng, 200), of_all_sizes(rng, 200)
    whole = A.align_batch(a, b, A.SCORINGS["affine"])
    seen = []
    by_differences = A._by_differences
    monkeypatch.setattr(A, "CELLS", 20_000)
    monkeypatch.setattr(A, "_by_differences", lambda x, y, s, parts: seen.append([(max(len(x[k]) for k in p) + 1) * (max(len(y[k]) for k in p) + 1) * len(p) for p in parts]) or by_differences(x, y, s, parts))
    assert A.align_batch(a, b, A.SCORINGS["affine"]) == whole
    assert len(seen) > 3 and all(sum(cells) <= 80_000 for cells in seen)


@pytest.mark.parametrize("letters", [1 << 26, 10])
def test_tasks_have_like_lengths_and_as_many_letters(spark, monkeypatch, letters):
    """By hash, each task would have some of the few long sequences, whose programs stand alone there."""
    monkeypatch.setattr(clusters, "MAX_LETTERS", letters)
    monkeypatch.setattr(clusters, "TASK_LETTERS", 4000)
    seqs = [(k, "ACGT" * (1 + (k % 50) ** 2 // 20)) for k in range(400)] + [(400, None), (401, "")]
    rows = spark.createDataFrame(seqs, "seq_id long, seq string").repartition(3)
    got = clusters.dealt(rows, rows.filter("seq_id <> 7").select("seq_id"))
    parts = got.withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.seq_id, r.seq) for r in parts) == [x for x in seqs if x[0] != 7]
    by = {}
    for r in parts:
        by.setdefault(r.p, []).append(len(r.seq or ""))
    total = sum(map(sum, by.values()))
    tasks = got.rdd.getNumPartitions()
    assert tasks == -(-sum(len(s or "") for _, s in seqs) // 4000)
    assert len(by) == tasks and max(map(sum, by.values())) < 1.5 * total / tasks
    # a task's lengths reach into those of its neighbours at most, the longest in the first
    ends = [(min(by[p]), max(by[p])) for p in sorted(by)]
    assert all(low >= next_low and high >= next_high for (low, high), (next_low, next_high) in zip(ends, ends[1:], strict=False))
    assert all(low <= 1.1 * (next_high + 4) for (low, _), (_, next_high) in zip(ends, ends[1:], strict=False)) and ends[0][0] > ends[-1][1]


@pytest.mark.parametrize("aligner", ["affine", "nw", "affine2", "ungapped"])
def test_roots_of_all_lengths(spark, aligner):
    rng = random.Random(8)
    roots = [(7, ""), *((k, word(rng, n)) for k, n in enumerate((40, 3, 90, 41, 1, 44)))]
    seqs = [(k, s) for k, s in enumerate([*of_all_sizes(rng, 60), *of_all_sizes(rng, 3)])]
    told = clusters.held_against(spark.createDataFrame(seqs, "seq_id long, seq string"), spark.createDataFrame(roots, "cluster_id long, root_seq string"), aligner, at_once=25)
    got = {r.seq_id: [(t.cluster_id, t.different, t.sites) for t in r.told] for r in told.collect()}

    def one(root, s):
        if aligner == "ungapped":
            return tuple(int(x[0]) for x in A.side_by_side([s], [root]))
        return A.site_counts(root, s, A._by_costs([root], [s], A.SCORINGS[aligner], None, None)[1][0])

    assert got == {i: [(c, *one(root, s)) for c, root in sorted(roots)] for i, s in seqs}
