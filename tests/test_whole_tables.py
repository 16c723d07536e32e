"""Queries that once read a sample, or a cheaper stand-in, do the whole job."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge import queries as Q
from cladeforge.functions.alignment import SCORINGS, align_batch
from cladeforge.operators import alignments, distances, likelihood, trees


def test_alignment_scores_are_of_every_document(spark, sf_dir, tmp_path):
    few = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 40").withColumn("text", F.substring("text", 1, 400))
    few.write.parquet(f"{tmp_path}/documents.parquet")
    at = str(tmp_path)
    docs = {r.seq_id: r.seq for r in Q.sequences(spark, at).collect()}
    roots = {r.cluster_id: r.root_seq for r in Q._roots(spark, at).collect()}
    assert len(docs) > 12 and roots
    for name, scoring in (("align_affine_score", "affine"), ("align_nw_score", "nw")):
        got = {(r.i, r.j): r.score for r in Q.QUERIES[name](spark, at).collect()}
        assert got == {(i, j): int(align_batch([a], [b], SCORINGS[scoring])[0][0]) for i, a in docs.items() for j, b in roots.items()}


def test_side_by_side_columns_equal_padded_ones(spark):
    rng = random.Random(3)
    rows = [(k % 2, k, "".join(rng.choices("ACGTN", k=rng.randrange(30)))) for k in range(90)]
    table = spark.createDataFrame(rows, "cluster_id long, seq_id long, seq string")
    width = {c: max(len(s) for x, _, s in rows if x == c) for c in (0, 1)}
    padded = spark.createDataFrame([(c, i, s.ljust(width[c], "-")) for c, i, s in rows], "cluster_id long, seq_id long, aligned string")
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(alignments.side_by_side_columns(table)) == as_rows(alignments.columns(padded))
    assert as_rows(alignments.consensus_of(alignments.side_by_side_columns(table))) == as_rows(alignments.consensus(padded))


@pytest.mark.parametrize("name", ["gapped_columns_all", "jc_distance_roots", "spaced_seed_roots", "site_patterns_roots"])
def test_all_documents_take_part(spark, sf_dir, name):
    n, got = Q.sequences(spark, sf_dir).count(), Q.QUERIES[name](spark, sf_dir)
    if name == "gapped_columns_all":
        assert {r.n for r in got.select("n").distinct().collect()} == {n}
    else:
        told = n if name != "site_patterns_roots" else Q.sequences(spark, sf_dir).filter("len > 0").count()
        assert got.select("i").distinct().count() == told


def test_a_shifted_copy_is_assigned_by_alignment(spark, sf_dir, tmp_path):
    """One base more at the start of a root's copy: side by side it is far from its root, aligned it is not."""
    root = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").withColumn("text", F.concat(F.substring("text", 1, 3000)))
    root = root.filter(F.length(F.regexp_replace("text", "[^ACGTNacgtn]", "")) > 400).limit(2)
    copies = root.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.concat(F.lit("G"), "text")})
    root.union(copies).union(copies.withColumn("doc_id", F.col("doc_id") + 1_000_000)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    at = str(tmp_path)
    assert Q._assigned(spark, at).filter("NOT is_assigned").count() > 0
    for name in ("aligned_assign", "aligned_stream_assign"):
        got = {r.seq_id: r for r in Q.QUERIES[name](spark, at).collect()}
        assert len(got) == 6
        roots = {r.cluster_id for r in Q._roots(spark, at).collect()}
        for c in roots:
            assert sum(r.cluster_id == c and r.is_assigned and r.d < 0.01 for r in got.values()) >= 3
    assert Q.QUERIES["aligned_saved_for_later"](spark, at).count() == sum(not r.is_assigned for r in got.values())


def test_holding_in_groups_equals_one_by_one(spark):
    from cladeforge.functions.alignment import site_counts
    from cladeforge.operators import clusters

    rng = random.Random(5)
    seqs = ["".join(rng.choices("ACGTN", k=rng.randrange(50))) for _ in range(120)]
    seqs += seqs[:30]
    roots = [(0, "".join(rng.choices("ACGT", k=40))), (1, "".join(rng.choices("ACGT", k=25)))]
    got = clusters.held_against(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"), spark.createDataFrame(roots, "cluster_id long, root_seq string"), at_once=7)
    told = {r.seq_id: [(t.cluster_id, t.different, t.sites) for t in r.told] for r in got.collect()}
    one = lambda root, s: site_counts(root, s, align_batch([root], [s], SCORINGS["affine"])[1][0])
    assert told == {i: [(c, *one(root, s)) for c, root in roots] for i, s in enumerate(seqs)}


@pytest.mark.parametrize("most", [32 << 20, 2000])
def test_no_anchor_is_left_out(spark, monkeypatch, most):
    from cladeforge.operators import clusters, distances

    monkeypatch.setattr(distances, "MAX_ANCHOR_BYTES", most)
    vectors = spark.createDataFrame([(k, [float(k % 100), 0.0]) for k in range(300)], "vec_id long, embedding array<double>")
    centres = vectors.filter("vec_id < 100")
    assert distances.to_anchors(vectors, centres).count() == 300 * 100
    got = {r.centre_id: (r.n, r.centre) for r in clusters.kmeans_step(vectors, centres).collect()}
    assert got == {k: (3, [float(k), 0.0]) for k in range(100)}


def test_all_benchmark_rows_take_part(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choices("ACGT", k=12))) for k in range(60)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = str(tmp_path)
    for name in ("edit_distance_pairs", "align_edit_score"):
        got = {(r.i, r.j): r.d for r in Q.QUERIES[name](spark, at).collect()}
        assert len(got) == 60 * 59 // 2
        assert all(d <= 12 for d in got.values())
    assert Q.QUERIES["nj_tree"](spark, at).filter("label IS NOT NULL").count() == 60
    members = Q._benchmark_clusters(spark, at).collect()
    sizes = Counter(r.cluster_id for r in members)
    assert sorted(r.seq_id for r in members) == list(range(60)) and [sizes[k] for k in sorted(sizes)] == [8] * 7 + [4]


def test_clusters_of_benchmark_against_one_at_a_time(spark, sf_dir):
    """Trees, alignments and roots of all clusters side by side are those of each cluster by itself."""
    members = Q._benchmark_clusters(spark, sf_dir)
    d = {(r.i, r.j): r.d for r in distances.pair_distances(Q._pairs_of_benchmark(spark, sf_dir)).collect()}
    held = {}
    for r in members.collect():
        held.setdefault(r.cluster_id, {})[r.seq_id] = r.seq
    got = {name: {} for name in ("nj_tree", "midpoint_root", "msa_columns", "gtr_root")}
    for name, by in got.items():
        for r in Q.QUERIES[name](spark, sf_dir).collect():
            by.setdefault(r["tree_id" if "tree_id" in r else "cluster_id"], []).append(r)
        assert set(by) == set(held), name
    for c, seqs in held.items():
        ids = sorted(seqs)
        matrix = np.array([[0.0 if i == j else d[min(i, j), max(i, j)] for j in ids] for i in ids])
        tree = trees.join_neighbours(matrix)
        for name, (parent, length) in (("nj_tree", tree), ("midpoint_root", trees.rooted_at_midpoint(*tree, len(ids)))):
            rows = sorted(got[name][c], key=lambda r: r.node_id)
            assert [r.parent for r in rows] == [None if p < 0 else p for p in parent] and np.allclose([r.bl for r in rows], length)
            assert [r.label for r in rows[: len(ids)]] == ids and rows[-1].nd == len(ids)
        aligned = alignments.align_cluster([seqs[i] for i in ids])
        assert {r.col: (r.n, r.A, r.C, r.G, r.T) for r in got["msa_columns"][c]} == {k: (len(ids), *((col == b).sum() for b in range(4))) for k, col in enumerate(aligned.T)}
        (root,) = got["gtr_root"][c]
        if len(ids) > 3:
            seq, value, _ = likelihood.root_sequence(aligned, *trees.rooted_at_midpoint(*tree, len(ids)))
            assert root.root_seq == seq and math.isclose(root.loglik, value, abs_tol=0.006)
        else:
            assert root.root_seq in seqs.values() and root.loglik is None


def test_clustering_is_of_documents(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k, "".join(rng.choices("ACGT", k=30)), "en", "web") for k in range(45)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.seq_id for r in Q.QUERIES["full_clustering"](spark, str(tmp_path)).collect()) == list(range(45))


def test_aligned_reports_against_plain_ones(spark, sf_dir, tmp_path):
    """Sizes, the largest, evenness, information, reports and leftovers of the aligned assignment, from distances by the kernel."""
    import math
    from collections import Counter

    from cladeforge.functions.alignment import site_counts

    few = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60").withColumn("text", F.substring("text", 1, 500))
    few.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    at = str(tmp_path)
    rows = {r.seq_id: r for r in Q.sequences(spark, at).collect()}
    roots = sorted((r.cluster_id, r.root_seq) for r in Q._roots(spark, at).collect())

    def distance(root, seq):
        _, paths = align_batch([root], [seq], SCORINGS["affine"])
        different, sites = site_counts(root, seq, paths[0])
        if sites < 5:
            return 1.0
        p = different / sites
        return abs(-0.75 * math.log(1 - 4 * p / 3)) if p < 0.7499 else 30.0

    near = {i: min((distance(root, r.seq), c) for c, root in roots) for i, r in rows.items()}
    got = {r.seq_id: r for r in Q.QUERIES["aligned_assign"](spark, at).collect()}
    assert {i: r.cluster_id for i, r in got.items()} == {i: c for i, (_, c) in near.items()}
    assert all(abs(r.d - near[i][0]) < 1e-5 and r.is_assigned == (near[i][0] < 1 and near[i][0] <= 0.75) for i, r in got.items())
    assert {r.seq_id for r in Q.QUERIES["aligned_saved_for_later"](spark, at).collect()} == {i for i, r in got.items() if not r.is_assigned}
    sizes = Counter(c for _, c in near.values())
    assert {r.cluster_id: r.n for r in Q.QUERIES["aligned_cluster_sizes"](spark, at).collect()} == sizes
    assert tuple(Q.QUERIES["aligned_largest_cluster"](spark, at).first()) == min(sizes.items(), key=lambda x: (-x[1], x[0]))
    mean = sum(sizes.values()) / len(sizes)
    cv = math.sqrt(sum((n - mean) ** 2 for n in sizes.values()) / len(sizes)) / mean
    assert abs(Q.QUERIES["aligned_size_cv"](spark, at).first().cv - cv) < 1e-5
    cells, taxa, n = Counter((c, rows[i].lang) for i, (_, c) in near.items()), Counter(r.lang for r in rows.values()), len(rows)
    mutual = sum(k / n * math.log(k * n / (sizes[c] * taxa[t])) for (c, t), k in cells.items())
    entropy = lambda counts: -sum(k / n * math.log(k / n) for k in counts.values())
    assert abs(Q.QUERIES["aligned_nmi"](spark, at).first().nmi - 2 * mutual / (entropy(sizes) + entropy(taxa))) < 1e-5
    lines = {(r.cluster_id, r.pos): r.line for r in Q.QUERIES["aligned_clstr_lines"](spark, at).collect()}
    expected = {(c, -1): f">Cluster {c}" for c in sizes}
    for c in sizes:
        for pos, i in enumerate(sorted(i for i, (_, x) in near.items() if x == c)):
            expected[c, pos] = f"{pos}\t{rows[i].len}nt, >{rows[i].name}..."
    assert lines == expected
