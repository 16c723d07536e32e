"""Ranks where rows are wide: partitions of the ranked rows and of their counts are the same ones, and no row is lost."""

import pytest
from pyspark.sql import functions as F

from cladeforge.operators import sampling, trees
from cladeforge.sources import files


@pytest.fixture
def wide(spark):
    """Rows whose letters are left out where only partitions are counted; partitions are joined at small sizes, as large tables' are at usual ones."""
    small = {"shuffle.partitions": "40", "adaptive.advisoryPartitionSizeInBytes": "20000", "adaptive.coalescePartitions.parallelismFirst": "false"}
    was = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.{k}", v)
    letters = F.concat(*[F.sha2((F.col("id") * 31 + k).cast("string"), 512) for k in range(3)])
    yield spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("seq_id"), (F.col("id") % 3).alias("cluster_id"), letters.alias("seq")).withColumn("len", F.length("seq"))
    for k, v in was.items():
        spark.conf.set(f"spark.sql.{k}", v)


def test_ranks_of_wide_rows_are_dense(wide):
    got = files.ranked(wide, ["seq_id"], "rank").select("seq_id", "rank").collect()
    assert sorted(map(tuple, got)) == [(k, k) for k in range(20_000)]


def test_written_fasta_comes_back_whole(spark, wide, tmp_path):
    files.write_fasta(wide.withColumn("name", F.col("seq_id").cast("string")), f"{tmp_path}/fasta", "cluster_id")
    got = files.read_fasta(spark, f"{tmp_path}/fasta", "cluster_id").select("cluster_id", "name", "len").collect()
    assert sorted((r[0], int(r[1]), r[2]) for r in got) == sorted((k % 3, k * 7919 % 20_000, 384) for k in range(20_000))


def test_report_of_wide_rows_has_all_members(wide):
    got = files.clstr_lines(wide.withColumn("name", F.col("seq"))).filter("pos >= 0").select("cluster_id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted((c, k) for c in range(3) for k in range(len(range(c, 20_000, 3))))


@pytest.fixture
def nodes(wide):
    """A root, 40 nodes below it and 20,000 leaves below those."""
    edges = wide.select(F.col("seq_id").alias("node"), (100_000 + F.col("seq_id") % 40).alias("parent"), F.lit(1.0).alias("bl"))
    inner = wide.sparkSession.range(100_000, 100_040).select(F.col("id").alias("node"), F.lit(200_000).alias("parent"), (F.col("id") % 40 + 1.0).alias("bl"))
    root = wide.sparkSession.range(200_000, 200_001).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("bl"))
    return edges.union(inner).union(root).withColumn("tree_id", F.lit(0).cast("long"))


def test_cuts_of_a_large_tree(nodes):
    tree = files.table(trees.from_edges(nodes), "tree")
    cuts = files.table(trees.cut_branches(tree, 8, 10), "cuts")
    assert sorted(map(tuple, cuts.select("node_id", "bl").collect())) == [(20_000 + k, k + 1.0) for k in range(33, 40)]
    got = {r.seq_id: r.cut_node for r in trees.leaf_clusters(tree, cuts).collect()}
    assert got == {k: 20_000 + k % 40 if k % 40 >= 33 else None for k in range(20_000)}


def test_labels_of_a_large_tree(nodes):
    got = sorted(map(tuple, trees.from_edges(nodes).select("node_id", "nd", "depth").collect()))
    assert got == [(k, 1, 2) for k in range(20_000)] + [(20_000 + k, 500, 1) for k in range(40)] + [(20_040, 20_000, 0)]


def test_anchors_of_wide_rows_stand_at_even_strides(wide):
    got = sorted(map(tuple, sampling.anchors_by_length(wide).select("rank", "seq_id").collect()))
    assert got == [(625 * k, 625 * k) for k in range(32)]
