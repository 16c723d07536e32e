import random

import numpy as np
import pytest

from cladeforge.llm import induced
from cladeforge.llm import suffix_dedup as sd

from .helpers import awkward, repeats


def check(spark, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = repeats(texts)
    assert [got[i] for i in range(len(texts))] == expected
    return expected


@pytest.mark.parametrize("most", [sd.MAX_GROUP, 3, 0])
def test_against_brute_force(spark, monkeypatch, most):
    """With grams induced together, with the crowded ones split, and with all split."""
    monkeypatch.setattr(sd, "MAX_GROUP", most)
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdé ", k=n))
    shared = make(900)
    texts = [make(rng.randint(0, 1500)) for _ in range(40)]
    for _ in range(60):
        a, n = rng.randint(0, 600), rng.choice([60, 120, 198, 199, 200, 201, 215, 260, 300])
        texts.append(make(rng.randint(0, 300)) + shared[a : a + n] + make(rng.randint(0, 300)))
    texts += ["ab" * 150, "ab" * 99, "ab" * 100, "ab" * 101, "x" * 199, "x" * 200, "x" * 201, shared, shared, None, ""]
    expected = check(spark, texts)
    assert sum(e[1] > 0 for e in expected) > 20


def test_many_surroundings_of_one_passage(spark, monkeypatch):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, ends = make(150), [make(60) for _ in range(6)]
    texts = [make(50) + rng.choice(ends) + passage + rng.choice(ends) + make(50) for _ in range(80)]
    assert sum(e[1] > 0 for e in check(spark, texts)) > 40
    monkeypatch.setattr(sd, "AT_ONCE", 16)
    check(spark, texts)


def test_induced_order_and_values():
    rng = random.Random(14)
    values = np.array([rng.randint(0, 9) for _ in range(50)], np.int32)
    i = np.array([rng.randint(0, 49) for _ in range(200)])
    j = np.array([rng.randint(a, 49) for a in i])
    assert induced.range_minimum(values, i, j).tolist() == [min(values[a : b + 1]) for a, b in zip(i, j, strict=True)]
    rows = sorted((g, bytes(rng.choices(b"ab", k=rng.randint(2, 7))), bytes(rng.choices(b"ab", k=rng.randint(0, 4)))) for g in (3, 9) for _ in range(30))
    group = np.array([r[0] for r in rows])
    for window in (3, 5, 7):
        row, d = induced.repeated_starts(group, [r[1] for r in rows], [r[2] for r in rows], window)
        starts = {(k, n): (g, n, (x[len(x) - n :] + y)[:window]) for k, (g, y, x) in enumerate(rows) for n in range(min(len(x) + 1, window)) if n + len(y) >= window}
        each = list(starts.values())
        assert sorted(zip(row.tolist(), d.tolist(), strict=True)) == sorted(k for k, v in starts.items() if each.count(v) > 1)


def test_one_byte_apart(spark):
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefghijklmnop", k=520))
    texts = [base] + [base[:i] + "#" + base[i + 1 :] for i in (0, 1, 199, 200, 201, 259, 319, 320, 321, 519)]
    check(spark, texts)


def test_overlapping_cuts_of_one_text(spark):
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefghijklmnop", k=700))
    check(spark, [base[i : i + 330] for i in range(0, 370, 37)] + [base[::-1]])


def test_awkward_rows(spark):
    docs, texts = awkward(spark)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(docs).collect()), key=str)
    assert got == sorted(((i, *e) for (i, *_), e in zip(texts, repeats([t[1] for t in texts]), strict=True)), key=str)
    assert sd.without_repeats(docs).columns == docs.columns
    assert sd.remove_repeats(docs.limit(0)).collect() == []
