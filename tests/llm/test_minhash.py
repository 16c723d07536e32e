import random

import numpy as np

from cladeforge.llm import minhash as mh
from cladeforge.llm.components import components

from .helpers import awkward, near_components


def edited(rng, words, share):
    return [rng.choice(["kappa", "sigma", "omega", "delta"]) + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


def test_against_all_pairs_with_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], rng.choices(vocabulary, k=160)
    for i in range(120):  # edits of one text: some pairs are links, some are just too far apart
        rows.append((i, " ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])))))
    for i in range(120, 220):
        text = rng.choices(vocabulary, k=rng.choice([3, 5, 7, 30, 60, 70, 80, 90, 120, 400]))
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(edited(rng, text, 0.03))))
        if i % 5 == 0:
            rows.append((2000 + i, " ".join(base[:12] + text)))
    rng.shuffle(rows)
    wanted, sizes = near_components(rows)
    got = {r.doc_id: r for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == wanted[i]) for i, r in got.items())


def test_crowded_keys_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 4)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    common = rng.choices(vocabulary, k=40)
    rows = [(i, " ".join(common + rng.choices(vocabulary, k=40))) for i in range(40)]
    rows += [(100 + i, " ".join(edited(rng, t.split(), 0.03))) for i, t in rows[5:30]]
    assert {r.doc_id: r.component_id for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == near_components(rows)[0]


def test_words_that_collide_modulo_powers_of_two(spark):
    order = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[i] for i in order)), (2, "".join("ba"[i] for i in order)), (3, "x " * 30 + "".join("ab"[i] for i in order))]
    rows += [(4, rows[0][1])]
    assert {r.doc_id: (r.component_id, r.kept) for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: (1, True), 2: (2, True), 3: (3, True), 4: (1, False)}


def test_awkward_rows(spark):
    docs, texts = awkward(spark)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in mh.near_duplicates(docs).collect()), key=str)
    known = {i: t for i, t, *_ in texts if i is not None}
    wanted, sizes = near_components(known.items())
    expected = [(i, sizes[i], wanted[i], i == wanted[i]) for i, *_ in texts if i is not None]
    assert [g for g in got if g[0] is not None] == sorted(expected, key=str)
    assert [g[2:] for g in got if g[0] is None] == [(None, True)]
    kept = mh.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, *_ in texts if i is None or wanted[i] == i)
    assert mh.near_duplicates(docs.limit(0)).collect() == []


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for shared in (200, 600, 900):
        a = rng.integers(0, 2**63, 1000).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 1000 - shared).astype(np.uint64)])
        regs = mh.registers(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        found = mh.estimate(regs[0], regs[1], np.array(1000), np.array(1000))
        assert abs(found - shared / (2000 - shared)) < 0.2
    far = mh.registers(rng.integers(0, 2**63, 100_000).astype(np.uint64), np.arange(0, 100_001, 1000))
    chance = np.mean([mh.estimate(far[i], far[i + 1], np.array(1000), np.array(1000)) for i in range(99)])
    assert abs(chance) < 0.002


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (203, 201), (201, 202), (202, 203)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 201: 201, 202: 201, 203: 201}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_solved_strings_share_nothing(spark):
    """Two strings that once had one hash: as words, in lines, and in shingles."""
    a, b = "aaaaaaaanqpsfxcf", "bbbbbbbb0/2s=|v]"
    rows = [(1, a), (2, b), (3, f"{a} x y z w v"), (4, f"{b} x y z w v"), (5, " ".join([a] * 5)), (6, " ".join([b] * 5)), (7, a), (8, f"{a} {b} {a} {b} {a}"), (9, f"{b} {a} {b} {a} {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(docs).collect()}
    assert got == near_components(rows)[0] and got[2] == 2 and got[7] == 1
