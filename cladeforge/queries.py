"""Queries over the driver's tables, one for each operator, and the same in SQL where SQL can express it.

The sequence of a document is its text without all letters but A C G T N, in upper case; ``lang`` and ``source`` stand in for
taxonomy. What compares all pairs runs over all of ``benchmark``, everything else over whole tables of documents; samples are
drawn only where the operator is sampling or a clustering round's sample.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequence as S
from .functions import table_functions
from .functions.alignment import SCORINGS, aligned
from .operators import alignments, bisecting, clusters, distances, likelihood, sampling, trees
from .plans import clustering
from .sources import fasta, files
from .streaming import assigning

SEED = 42
#: Cost up to which ``capped_pairs`` tells a pair.
MOST = 150


def sequences(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kept = [c for c in ("lang", "source") if c in rows.columns]
    return rows.select(F.col(key).alias("seq_id"), F.concat(F.lit("doc"), F.col(key)).alias("name"), S.clean(F.col("text")).alias("seq"), *kept).withColumn("len", F.length("seq"))


def _sample(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return sampling.sample_k(sequences(spark, sf_dir), k, SEED)


def _language_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative of each language: the first of the sample's order with 100 letters or more."""
    able = sequences(spark, sf_dir).filter("len >= 100")
    first = able.groupBy("lang").agg(F.min_by("seq", F.struct(sampling.draw(F.col("seq_id"), SEED), F.col("seq_id"))).alias("root_seq"))
    return first.select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).cast("long").alias("cluster_id"), "root_seq")  # a row a language


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: what uses roots looks at them more than once."""
    return files.table(_language_roots(spark, sf_dir).drop("lang"), "roots")


def _against_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every root: ``i, j, a, b`` as of pairs, ``j`` the root's cluster. Linear in the documents; nothing is shuffled."""
    rows = sequences(spark, sf_dir).select(F.col("seq_id").alias("i"), F.col("seq").alias("a"))
    roots = _roots(spark, sf_dir).select(F.col("cluster_id").alias("j"), F.col("root_seq").alias("b"))
    return rows.join(F.broadcast(roots))  # a root a language


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side by side, without alignment: what SQL can express."""
    return clusters.assign(sequences(spark, sf_dir), _roots(spark, sf_dir), 0.75, "ungapped")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the clustering run assigns: by affine alignment, equal sequences once."""
    return clusters.assign_once(sequences(spark, sf_dir), _roots(spark, sf_dir), 0.75)


def _region_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under their nations, nations under regions, regions under one root; branches of unequal lengths."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    length = lambda key, a, b: ((F.col(key) * a % b + 1) / 8).alias("bl")
    nation, region, root = 1 << 40, 1 << 41, 1 << 42
    rows = [
        read("customer").select(F.col("c_custkey").cast("long").alias("node"), (F.col("c_nationkey") + F.lit(nation)).alias("parent"), length("c_custkey", 7, 5)),
        read("nation").select((F.col("n_nationkey") + F.lit(nation)).alias("node"), (F.col("n_regionkey") + F.lit(region)).alias("parent"), length("n_nationkey", 11, 23)),
        read("region").select((F.col("r_regionkey") + F.lit(region)).alias("node"), F.lit(root).alias("parent"), length("r_regionkey", 3, 4)),
        spark.range(1).select(F.lit(root).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("bl")),
    ]
    return trees.from_edges(functools.reduce(DataFrame.union, rows).withColumn("tree_id", F.lit(0).cast("long")))


def _pairs_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.pairs(sequences(spark, sf_dir, "benchmark", "item_id"))


#: Sequences of a cluster of ``benchmark``; the last cluster may have fewer.
CLUSTER = 8


def _benchmark_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster_id, seq_id, seq``: all of ``benchmark`` in clusters of CLUSTER sequences that follow each other by their letters.

    Clusters grow in number with the table, not in size, so what is built of each (a tree, an alignment, a root) is a small task.
    """
    rows = sequences(spark, sf_dir, "benchmark", "item_id").select("seq_id", "seq")
    placed = files.ranked(rows, ["seq", "seq_id"], "place")
    return files.table(placed.select(F.floor(F.col("place") / CLUSTER).alias("cluster_id"), "seq_id", "seq"), "clusters")


def _cluster_distances(members: DataFrame) -> DataFrame:
    """``cluster_id, i, j, d`` of the pairs within clusters, by affine alignment."""
    return distances.pair_distances(distances.pairs(members, within="cluster_id"), "affine", ["cluster_id"]).select("cluster_id", "i", "j", "d")


def _cluster_trees(spark: SparkSession, sf_dir: str, midpoint: bool = False) -> DataFrame:
    """A tree of each cluster of ``benchmark``; one of a single sequence is its leaf."""
    members = _benchmark_clusters(spark, sf_dir)
    itself = members.select("cluster_id", F.col("seq_id").alias("i"), F.col("seq_id").alias("j"), F.lit(0.0).alias("d"))
    return trees.trees(_cluster_distances(members).union(itself).withColumnRenamed("cluster_id", "tree_id"), midpoint)


def seq_stats(spark, sf_dir):
    return files.statistics(sequences(spark, sf_dir))


def seq_length_filter(spark, sf_dir):
    return sequences(spark, sf_dir).filter("len BETWEEN 100 AND 6000").select("seq_id", "len")


def base_composition(spark, sf_dir):
    return sequences(spark, sf_dir).groupBy("lang").agg(*[F.sum(S.letters(F.col("seq"), b)).alias(f"n_{b.lower()}") for b in "ACGTN"])


def base_code_counts(spark, sf_dir):
    codes = sequences(spark, sf_dir).select("source", S.base_codes(F.col("seq")).alias("codes"))
    return codes.groupBy("source").agg(*[F.sum(S.letters(F.col("codes"), str(c))).alias(f"code_{c}") for c in range(5)])


def alphabet_detect(spark, sf_dir):
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    every = sorted(set(S.PROTEIN_LETTERS + S.DNA_LETTERS))
    counted = text.groupBy("lang").agg(*[F.sum(S.letters(F.col("text"), c)).alias(f"c{ord(c)}") for c in every])
    dna, protein = S.letter_scores({c: F.col(f"c{ord(c)}") for c in every})
    return counted.select("lang", sum((F.col(f"c{ord(c)}") for c in every), F.lit(0)).cast("long").alias("letters"), F.when(dna > protein, "dna").when(dna < protein, "protein").otherwise("unknown").alias("alphabet"))


def fasta_column(spark, sf_dir):
    """Two records in each document's column, of which the second's lines are wrapped."""
    rows = sequences(spark, sf_dir)
    text = F.concat(F.lit(">"), "name", F.lit("\n"), F.lower("seq"), F.lit("\n>tail of "), "name", F.lit("\r\n"), F.substr("seq", F.lit(1), F.lit(60)), F.lit("\n"), F.substr("seq", F.lit(61)), F.lit("\n"))
    records = rows.select("seq_id", F.posexplode(S.fasta_records(text)).alias("place", "r"))
    return records.select("seq_id", "place", "r.name", S.gcg_checksum(F.col("r.seq")).alias("checksum"))


def gcg_checksum(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", S.gcg_checksum(F.col("seq")).alias("checksum"))


def sample_k(spark, sf_dir):
    return _sample(spark, sf_dir, 50).select("seq_id", "len")


def sample_semi(spark, sf_dir):
    rows = sequences(spark, sf_dir)
    return sampling.only(rows, _sample(spark, sf_dir, 50)).select("seq_id", "name")


def remaining_anti(spark, sf_dir):
    return sampling.without(sequences(spark, sf_dir), _sample(spark, sf_dir, 50)).select("seq_id", "name")


def random_member(spark, sf_dir):
    members = sequences(spark, sf_dir).select(F.col("source").alias("cluster_id"), "seq_id")
    return sampling.random_member(members, SEED)


def pair_count(spark, sf_dir):
    return sequences(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", "n", distances.number_of_pairs(F.col("n")).alias("pairs"))


def site_patterns(spark, sf_dir):
    """Of all pairs of ``benchmark``."""
    return distances.binary_patterns(_pairs_of_benchmark(spark, sf_dir))


def jc_distance(spark, sf_dir):
    """Of all pairs of ``benchmark``, side by side."""
    return distances.pair_distances(_pairs_of_benchmark(spark, sf_dir), "ungapped").select("i", "j", F.round("d", 6).alias("d"))


def edit_distance_pairs(spark, sf_dir):
    return _pairs_of_benchmark(spark, sf_dir).select("i", "j", F.levenshtein("a", "b").cast("long").alias("d"))


def align_edit_score(spark, sf_dir):
    return aligned(_pairs_of_benchmark(spark, sf_dir), "edit").select("i", "j", F.col("alignment.score").cast("long").alias("d"))


def affine_pairs(spark, sf_dir):
    rows = aligned(_pairs_of_benchmark(spark, sf_dir), "affine").select("i", "j", "alignment.*")
    return rows.select("i", "j", "score", "different", "sites", S.cigar_affine_cost(F.col("cigar")).alias("cigar_cost"))


def affine2_pairs(spark, sf_dir):
    """All pairs of ``benchmark`` at two-piece costs, and each sequence with itself set into its middle, so that there are long gaps."""
    rows = sequences(spark, sf_dir, "benchmark", "item_id").select("seq_id", "seq")
    half = F.floor(F.length("seq") / 2).cast("int")
    parted = rows.select(F.col("seq_id").alias("i"), (-F.col("seq_id") - 1).alias("j"), F.col("seq").alias("a"), F.concat(F.left("seq", half), "seq", F.substr("seq", half + 1)).alias("b"))
    pairs = _pairs_of_benchmark(spark, sf_dir).select("i", "j", "a", "b").union(parted)
    told = aligned(pairs, "affine2").select("i", "j", "alignment.*")
    return told.select("i", "j", "score", "different", "sites", S.cigar_affine2_cost(F.col("cigar")).alias("cigar_cost"))


def nw_pairs(spark, sf_dir):
    return aligned(_pairs_of_benchmark(spark, sf_dir), "nw").select("i", "j", "alignment.score", "alignment.different", "alignment.sites")


def capped_pairs(spark, sf_dir):
    """Only pairs that cost MOST at most; the work on the others ends there."""
    rows = aligned(_pairs_of_benchmark(spark, sf_dir), "affine", max_score=MOST).filter("alignment IS NOT NULL")
    return rows.select("i", "j", "alignment.score", "alignment.different", "alignment.sites")


def _benchmark_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.sample_k(sequences(spark, sf_dir, "benchmark", "item_id"), 4, SEED)
    return files.table(drawn.select((F.row_number().over(Window.orderBy("seq_id")) - 1).cast("long").alias("cluster_id"), F.col("seq").alias("root_seq")), "roots")  # four rows


def _benchmark_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``benchmark`` to four of its sequences, by affine alignment as in the clustering run."""
    return clusters.assign(sequences(spark, sf_dir, "benchmark", "item_id"), _benchmark_roots(spark, sf_dir), 0.75)


def affine_assign(spark, sf_dir):
    return _benchmark_assigned(spark, sf_dir).select("seq_id", "cluster_id", F.round("d", 6).alias("d"), "is_assigned")


def affine_sizes(spark, sf_dir):
    return clusters.sizes(_benchmark_assigned(spark, sf_dir))


def affine_largest(spark, sf_dir):
    return clusters.largest(_benchmark_assigned(spark, sf_dir))


def affine_cv(spark, sf_dir):
    return clusters.evenness(_benchmark_assigned(spark, sf_dir)).select(F.round("cv", 6).alias("cv"))


def affine_report(spark, sf_dir):
    told = files.table(_benchmark_assigned(spark, sf_dir).select("seq_id", "cluster_id"), "assigned")
    return files.clstr_lines(told.join(sequences(spark, sf_dir, "benchmark", "item_id").select("seq_id", "name", "len"), "seq_id"))


def affine_mean_between(spark, sf_dir):
    d = distances.pair_distances(_pairs_of_benchmark(spark, sf_dir))
    return distances.mean_between(d, _benchmark_assigned(spark, sf_dir)).select(F.round("mean", 6).alias("mean"))


def site_patterns_roots(spark, sf_dir):
    return distances.binary_patterns(_against_roots(spark, sf_dir))


def jc_distance_roots(spark, sf_dir):
    return distances.pair_distances(_against_roots(spark, sf_dir), "ungapped").select("i", "j", F.round("d", 6).alias("d"))


def _scores(spark: SparkSession, sf_dir: str, aligner: str) -> DataFrame:
    return clusters.scores_once(sequences(spark, sf_dir), _roots(spark, sf_dir), aligner).withColumnsRenamed({"seq_id": "i", "cluster_id": "j"})


def align_affine_score(spark, sf_dir):
    """Every document against every root."""
    return _scores(spark, sf_dir, "affine").select("i", "j", "score", "different", "sites", S.cigar_affine_cost(F.col("cigar")).alias("cigar_cost"))


def align_nw_score(spark, sf_dir):
    """Every document against every root."""
    return _scores(spark, sf_dir, "nw").select("i", "j", "score", "different", "sites")


def mean_between_groups(spark, sf_dir):
    """Of all of ``benchmark``, side by side, in groups by the first letter."""
    rows = sequences(spark, sf_dir, "benchmark", "item_id")
    d = distances.pair_distances(distances.pairs(rows), "ungapped")
    members = rows.select("seq_id", F.instr(F.lit("ACGT"), F.substr("seq", F.lit(1), F.lit(1))).alias("cluster_id"))
    return distances.mean_between(d, members).select(F.round("mean", 6).alias("mean"))


def mean_between_roots(spark, sf_dir):
    """As ``mean_between_groups``, of every document: those of a language against the roots of the others."""
    d = distances.pair_distances(_against_roots(spark, sf_dir), "ungapped")
    own = _language_roots(spark, sf_dir).select("lang", F.col("cluster_id").alias("ci"))
    members = sequences(spark, sf_dir).select(F.col("seq_id").alias("i"), "lang").join(F.broadcast(own), "lang").select("i", "ci")
    named = d.select("i", F.col("j").alias("cj"), "d").join(members, "i").filter("ci <> cj")
    each = named.groupBy(F.least("ci", "cj"), F.greatest("ci", "cj")).agg(F.avg("d").alias("d"))
    return each.agg(F.round(F.avg("d"), 6).alias("mean"))


def nearest_root_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("seq_id", "cluster_id", F.round("d", 6).alias("d"), "is_assigned")


def saved_for_later(spark, sf_dir):
    return _assigned(spark, sf_dir).filter(~F.col("is_assigned")).select("seq_id")


def cluster_sizes(spark, sf_dir):
    return clusters.sizes(_assigned(spark, sf_dir))


def largest_cluster(spark, sf_dir):
    return clusters.largest(_assigned(spark, sf_dir))


def size_cv(spark, sf_dir):
    return clusters.evenness(_assigned(spark, sf_dir)).select(F.round("cv", 6).alias("cv"))


def nmi_vs_taxonomy(spark, sf_dir):
    taxa = sequences(spark, sf_dir).select("seq_id", F.col("lang").alias("taxon"))
    return clusters.shared_information(_assigned(spark, sf_dir), taxa).select(F.round("nmi", 6).alias("nmi"))


def aligned_assign(spark, sf_dir):
    return _aligned(spark, sf_dir).select("seq_id", "cluster_id", F.round("d", 6).alias("d"), "is_assigned")


def aligned_saved_for_later(spark, sf_dir):
    return _aligned(spark, sf_dir).filter(~F.col("is_assigned")).select("seq_id")


def aligned_cluster_sizes(spark, sf_dir):
    return clusters.sizes(_aligned(spark, sf_dir))


def aligned_largest_cluster(spark, sf_dir):
    return clusters.largest(_aligned(spark, sf_dir))


def aligned_size_cv(spark, sf_dir):
    return clusters.evenness(_aligned(spark, sf_dir)).select(F.round("cv", 6).alias("cv"))


def aligned_nmi(spark, sf_dir):
    taxa = sequences(spark, sf_dir).select("seq_id", F.col("lang").alias("taxon"))
    return clusters.shared_information(_aligned(spark, sf_dir), taxa).select(F.round("nmi", 6).alias("nmi"))


def taxonomy_join(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("seq_id"), "quality")
    told = sequences(spark, sf_dir).select("seq_id", "name").join(labels, "seq_id", "left")
    return told.select("seq_id", "name", F.coalesce(F.col("quality").cast("string"), F.lit("(null)")).alias("taxon"))


def _report(spark, sf_dir, assigned: DataFrame) -> DataFrame:
    """The assignment is written once: ranks look at their rows more than once."""
    told = files.table(assigned.select("seq_id", "cluster_id"), "assigned")
    return files.clstr_lines(told.join(sequences(spark, sf_dir).select("seq_id", "name", "len"), "seq_id"))


def clstr_lines(spark, sf_dir):
    return _report(spark, sf_dir, _assigned(spark, sf_dir))


def aligned_clstr_lines(spark, sf_dir):
    return _report(spark, sf_dir, _aligned(spark, sf_dir))


def length_summary(spark, sf_dir):
    rows = clusters.length_summary(sequences(spark, sf_dir), 10, 2000)
    return rows.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


def dup_names(spark, sf_dir):
    return files.duplicate_names(sequences(spark, sf_dir).withColumn("name", F.concat("source", F.lit("/"), "lang")))


def unique_names(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumn("name", F.concat("source", F.lit("/"), "lang"))
    return files.unique_names(rows).select("seq_id", "name")


def dense_ranks(spark, sf_dir):
    return files.ranked(sequences(spark, sf_dir).select("seq_id", "len"), ["len", "seq_id"], "rank")


def top_branches(spark, sf_dir):
    return trees.cut_branches(_region_tree(spark, sf_dir), 8, 10).select("node_id", "bl")


def nearest_cut(spark, sf_dir):
    tree = files.table(_region_tree(spark, sf_dir), "tree")
    return trees.leaf_clusters(tree, trees.cut_branches(tree, 8, 10)).fillna(-1, ["cut_node"])


def tree_labels(spark, sf_dir):
    return _region_tree(spark, sf_dir).select("node_id", F.col("nd").cast("long").alias("nd"), F.col("depth").cast("long").alias("depth"), F.round("dist_root", 6).alias("dist_root"))


def common_ancestors(spark, sf_dir):
    """Of each two leaves that follow each other."""
    tree = files.table(_region_tree(spark, sf_dir), "tree")
    leaves = tree.filter("label IS NOT NULL").select("node_id")
    pairs = leaves.toDF("a").join(leaves.toDF("b"), F.col("b") == F.col("a") + 1)
    return trees.lowest_common_ancestor(tree, pairs).withColumn("distance", F.round("distance", 6))


def _side_by_side(spark, sf_dir) -> DataFrame:
    """All of ``benchmark`` as if aligned: filled with gaps up to the longest."""
    sample = sequences(spark, sf_dir, "benchmark", "item_id").select("seq_id", "seq", "len")
    width = sample.agg(F.max("len").alias("w"))
    return sample.join(F.broadcast(width)).select(F.lit(0).cast("long").alias("cluster_id"), "seq_id", F.rpad("seq", F.col("w"), F.lit("-")).alias("aligned"))


def gapped_columns(spark, sf_dir):
    return alignments.kept_columns(_side_by_side(spark, sf_dir)).select("cluster_id", "col", "n", "gaps")


def consensus_base(spark, sf_dir):
    return alignments.consensus(_side_by_side(spark, sf_dir))


def gapped_columns_all(spark, sf_dir):
    rows = sequences(spark, sf_dir).select(F.lit(0).cast("long").alias("cluster_id"), "seq")
    return alignments.kept(alignments.side_by_side_columns(rows)).select("cluster_id", "col", "n", "gaps")


def consensus_base_all(spark, sf_dir):
    rows = sequences(spark, sf_dir).select(F.lit(0).cast("long").alias("cluster_id"), "seq")
    return alignments.consensus_of(alignments.side_by_side_columns(rows))


def spaced_seed_similarity(spark, sf_dir):
    """Of all pairs of ``benchmark``, by an index of their seeds."""
    rows = sequences(spark, sf_dir, "benchmark", "item_id")
    left, right = rows.select(F.col("seq_id").alias("i"), "seq"), rows.select(F.col("seq_id").alias("j"), "seq")
    found = distances.seed_similarity(left, right).filter("i < j")
    every = left.select("i").join(F.broadcast(right.select("j")), F.col("i") < F.col("j"))
    return every.join(found, ["i", "j"], "left").select("i", "j", F.coalesce("similarity", F.lit(0).cast("long")).alias("similarity"))


def spaced_seed_roots(spark, sf_dir):
    """Every document against every root, by an index of their seeds."""
    rows = files.table(sequences(spark, sf_dir).select(F.col("seq_id").alias("i"), "seq"), "sequences")  # texts are cleaned once
    roots = _roots(spark, sf_dir).select(F.col("cluster_id").alias("j"), F.col("root_seq").alias("seq"))
    found = distances.seed_similarity(rows, roots)
    every = rows.select("i").join(F.broadcast(roots.select("j")))  # a root a language
    return every.join(found, ["i", "j"], "left").select("i", "j", F.coalesce("similarity", F.lit(0).cast("long")).alias("similarity"))


def anchors_by_length(spark, sf_dir):
    return sampling.anchors_by_length(sequences(spark, sf_dir)).select("seq_id", "len", "rank")


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def euclid_to_anchor(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return distances.to_anchors(vectors, sampling.sample_k(vectors, 4, SEED, "vec_id")).withColumn("d", F.round("d", 5))


def kmeans_one_step(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    step = clusters.kmeans_step(vectors, sampling.sample_k(vectors, 4, SEED, "vec_id"))
    return step.select("centre_id", "n", F.posexplode("centre").alias("dim", "x")).withColumn("x", F.round("x", 5))


def cigar_ops(spark, sf_dir):
    """Counts, costs, gapped strings and validity of the CIGARs of all pairs of ``benchmark``."""
    c = F.col("cigar")
    rows = aligned(_pairs_of_benchmark(spark, sf_dir), "affine").select("i", "j", "a", "b", "alignment.cigar")
    x, y = S.gapped(c, F.col("a"), F.col("b"))
    return rows.select("i", "j", S.cigar_matches(c).alias("matches"), S.cigar_edits(c).alias("edits"), S.cigar_linear_cost(c).alias("linear"), S.cigar_affine_cost(c).alias("affine"), S.cigar_affine2_cost(c).alias("affine2"), x.alias("x"), y.alias("y"), S.cigar_is_valid(c, F.col("a"), F.col("b")).alias("valid"))


def nj_tree(spark, sf_dir):
    """Of each cluster of ``benchmark``."""
    return _cluster_trees(spark, sf_dir)


def midpoint_root(spark, sf_dir):
    """Of each cluster of ``benchmark``."""
    return _cluster_trees(spark, sf_dir, midpoint=True)


def msa_columns(spark, sf_dir):
    """Of each cluster of ``benchmark``."""
    return alignments.columns(alignments.msa(_benchmark_clusters(spark, sf_dir)))


def gtr_root(spark, sf_dir):
    """Roots of the clusters of ``benchmark``: the ancestral sequence of those of more than 3, a member of others (without ``loglik``)."""
    members = _benchmark_clusters(spark, sf_dir)
    count = clusters.sizes(members)
    large = files.table(members.join(count.filter("n > 3"), "cluster_id", "left_semi"), "large-clusters")
    small = sampling.random_member(members.join(count.filter("n <= 3"), "cluster_id", "left_semi"), SEED)
    fitted = likelihood.roots(alignments.msa(large), _cluster_distances(large)).select("cluster_id", "root_seq", F.round("loglik", 2).alias("loglik"))
    return fitted.union(small.select("cluster_id", "seq", F.lit(None).cast("double")))


#: Sampled sequences of a round of ``full_clustering``: all of their pairs are aligned.
ROUND_SAMPLE = 100


def full_clustering(spark, sf_dir):
    """All documents in ten clusters a round; a table of fewer than ROUND_SAMPLE is its own sample."""
    rows = sequences(spark, sf_dir)
    members, _ = clustering.run(rows, clustering.Options(clusters=10, sample=min(ROUND_SAMPLE, rows.count())))
    return members


def _stream_of_documents(spark, sf_dir) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    reader = spark.readStream.schema(documents.schema)
    # a stream reads folders: the table is one, or a file in one
    alone = all(f.endswith("/documents.parquet") for f in documents.inputFiles())
    source = reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir) if alone else reader.parquet(f"{sf_dir}/documents.parquet")
    return source.select(F.col("doc_id").alias("seq_id"), S.clean(F.col("text")).alias("seq"))


def _streamed(spark, sf_dir, aligner: str) -> DataFrame:
    stream, roots = _stream_of_documents(spark, sf_dir), _roots(spark, sf_dir)
    at = f"{files.shared_folder(spark)}/cladeforge/stream-{uuid.uuid4().hex}"
    assigning.start_assigning(stream, roots, 0.75, f"{at}/out", f"{at}/checkpoint", aligner).awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("d", F.round("d", 6))


def stream_assign(spark, sf_dir):
    return _streamed(spark, sf_dir, "ungapped")


def aligned_stream_assign(spark, sf_dir):
    return _streamed(spark, sf_dir, "affine")


def stream_pool(spark, sf_dir):
    """What a stream leaves over, side by side; each micro-batch under its own number."""
    at = f"{files.shared_folder(spark)}/cladeforge/stream-{uuid.uuid4().hex}"
    assigning.start_pooling(_stream_of_documents(spark, sf_dir), _roots(spark, sf_dir), 0.75, f"{at}/out", f"{at}/checkpoint", "ungapped").awaitTermination()
    return assigning.pool_rows(spark, f"{at}/out").select("seq_id", F.length("seq").alias("len"), F.round("d", 6).alias("d"))


def fasta_source(spark, sf_dir):
    """Documents written as FASTA files and read through the source format."""
    at = f"{files.shared_folder(spark)}/cladeforge/fasta-{uuid.uuid4().hex}"
    files.write_fasta(sequences(spark, sf_dir), at)
    return fasta.fasta_table(spark, at).select("name", "len", S.gcg_checksum(F.col("seq")).alias("checksum"))


def _written(spark: SparkSession, name: str) -> str:
    return f"{files.shared_folder(spark)}/cladeforge/{name}-{uuid.uuid4().hex}"


def fasta_by_language(spark, sf_dir):
    """Documents written as FASTA, a folder a language, and read back with the folders' column."""
    at = _written(spark, "fasta")
    files.write_fasta(sequences(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("none"))), at, "lang")
    return files.read_fasta(spark, at, "lang").select("lang", "name", "len", S.gcg_checksum(F.col("seq")).alias("checksum"))


def taxonomy_files(spark, sf_dir):
    """A taxonomy with a line a document, by source, language and length, written and read back: of equal names the first line stays."""
    at = _written(spark, "taxonomy")
    name = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("len") % 10)
    rows = sequences(spark, sf_dir).repartitionByRange("seq_id").sortWithinPartitions("seq_id")
    files.write_taxonomy(rows.select(F.concat_ws(";", "lang", "source", F.concat(F.lit("doc"), "seq_id")).alias("lineage"), name.alias("name")), at)
    return files.read_taxonomy(spark, at).select("name", "lineage", F.size("ranks").alias("n_ranks"))


def root_files(spark, sf_dir):
    """Roots written and read back; those of even length as if they stood in for a small cluster's."""
    at = _written(spark, "roots")
    files.write_roots(_roots(spark, sf_dir).withColumn("random", F.length("root_seq") % 2 == 0), at)
    return files.read_fasta(spark, at).select("name", "len", S.gcg_checksum(F.col("seq")).alias("checksum"))


def alignment_files(spark, sf_dir):
    """All of ``benchmark``, side by side, written as Clustal, MSF and FASTA and read back by what each file is found to be."""
    rows, parts = files.table(_side_by_side(spark, sf_dir).select("seq_id", F.concat(F.lit("doc"), "seq_id").alias("name"), "aligned"), "aligned"), []
    for kind in ("clustal", "msf", "fasta"):
        at = _written(spark, kind)
        files.write_alignment(rows, at, kind)
        found = files.detect_format(spark, at)
        read = {"clustal": files.read_clustal, "msf": files.read_msf}.get(found)
        back = read(spark, at) if read else files.read_fasta(spark, at).select("name", F.col("seq").alias("aligned"))
        state = files.is_aligned(back.select(F.col("name").alias("seq_id"), F.col("aligned").alias("seq")))
        parts.append(back.select(F.lit(found).alias("format"), F.lit(state).alias("state"), "name", F.length("aligned").alias("len"), S.gcg_checksum(F.col("aligned")).alias("checksum")))
    return functools.reduce(DataFrame.union, parts)


def cigar_lengths(spark, sf_dir):
    """Letters of each operation, over the CIGARs of all pairs of ``benchmark``, by a table function in SQL."""
    table_functions.register(spark)
    pairs = aligned(_pairs_of_benchmark(spark, sf_dir), "affine").select("i", "j", "alignment.cigar")
    text = "SELECT i, j, o.op, sum(o.n) AS n, count(*) AS runs, min(o.a_start) AS a_start, min(o.b_start) AS b_start FROM {pairs}, LATERAL cigar_ops(cigar) o GROUP BY i, j, o.op"
    return spark.sql(text, pairs=pairs)


def seed_counts(spark, sf_dir):
    """How often each spaced seed stands in the documents of a language, by a table function in SQL: seeds are summed where documents are."""
    table_functions.register(spark)
    return spark.sql("SELECT grp AS lang, code, sum(n) AS n, min(place) AS place FROM seed_totals(TABLE(SELECT lang, seq FROM {rows})) GROUP BY grp, code", rows=sequences(spark, sf_dir))


def fasta_lines(spark, sf_dir):
    """Records of FASTA text in a column, one of each document with wrapped lines, by a table function in SQL."""
    table_functions.register(spark)
    rows = sequences(spark, sf_dir).select("seq_id", F.concat(F.lit("; note\n>"), "name", F.lit("\r\n"), F.lower(F.regexp_replace("seq", "(.{50})", "$1\r\n")), F.lit("\n>end of "), "name").alias("text"))
    return spark.sql("SELECT seq_id, r.place, r.name, r.seq FROM {rows}, LATERAL fasta_records(text) r", rows=rows).select("seq_id", "place", "name", S.gcg_checksum(F.col("seq")).alias("checksum"))


def distance_matrix(spark, sf_dir):
    """Affine distances of all of ``benchmark`` as a matrix, 16 columns a row."""
    d = distances.pair_distances(_pairs_of_benchmark(spark, sf_dir)).select("i", "j", "d")
    rows = distances.matrix(d, sequences(spark, sf_dir, "benchmark", "item_id"), 16)
    return rows.select("i", "block", *[F.round(f"c{k}", 6).alias(f"c{k}") for k in range(16)])


def bisect_level(spark, sf_dir):
    """One level of bisecting k-means over all vectors, with labels as nodes: first centres, and the sides they give."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq_id"), F.col("label").cast("string").alias("node"), F.col("embedding").cast("array<double>").alias("vector"))
    return bisecting.split(rows, 1).select("seq_id", "node", "side")


def bisecting_documents(spark, sf_dir):
    """The leaf of every document: vectors of seed similarity to 32 anchors, split until nodes have fewer than 100."""
    rows = files.table(sequences(spark, sf_dir).select("seq_id", "seq", "len"), "sequences")  # texts are cleaned once
    return bisecting.bisecting_tree(bisecting.anchor_vectors(rows))


#: A tree of four roots and a sequence, leaves first: branches by node; and the grid of base frequencies relative to T's.
QUINTET, BRANCHES = (5, 5, 6, 6, 8, 7, 7, 8, -1), (0.1, 0.2, 0.3, 0.15, 0.5, 0.05, 0.1, 0.2, 0.0)
FREQUENCIES = ((1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (1.5, 0.5, 0.5), (0.7, 0.8, 0.9))


def quintet_likelihood(spark, sf_dir):
    """Log-likelihood of every document beside the roots of four languages, for a grid of base frequencies in one job."""
    few = [r.root_seq for r in _roots(spark, sf_dir).orderBy("cluster_id").limit(4).collect()]
    patterns = likelihood.patterns_against(sequences(spark, sf_dir), few + [""] * (4 - len(few)))
    grid = [(*f, 1.0, 1.0, 1.0, 1.0, 1.0) for f in FREQUENCIES]
    return likelihood.log_likelihoods(files.table(patterns, "patterns"), QUINTET, BRANCHES, grid).withColumn("loglik", F.round("loglik", 2))


QUERIES = {f.__name__: f for f in (
    seq_stats, seq_length_filter, base_composition, base_code_counts, alphabet_detect, gcg_checksum, fasta_column, sample_k, sample_semi, remaining_anti, random_member, pair_count,
    site_patterns, jc_distance, edit_distance_pairs, align_edit_score, align_affine_score, align_nw_score, mean_between_groups, nearest_root_assign, saved_for_later, cluster_sizes,
    largest_cluster, size_cv, nmi_vs_taxonomy, taxonomy_join, clstr_lines, length_summary, dup_names, unique_names, dense_ranks, top_branches, nearest_cut, tree_labels,
    common_ancestors, gapped_columns, consensus_base, spaced_seed_similarity, anchors_by_length, euclid_to_anchor, kmeans_one_step, cigar_ops, nj_tree, midpoint_root, msa_columns, gtr_root,
    affine_pairs, affine2_pairs, nw_pairs, capped_pairs, affine_assign, affine_sizes, affine_largest, affine_cv, affine_report, affine_mean_between, full_clustering, stream_assign, site_patterns_roots, jc_distance_roots, mean_between_roots, gapped_columns_all, consensus_base_all, spaced_seed_roots,
    aligned_assign, aligned_saved_for_later, aligned_cluster_sizes, aligned_largest_cluster, aligned_size_cv, aligned_nmi, aligned_clstr_lines, aligned_stream_assign,
    stream_pool, fasta_source, cigar_lengths, seed_counts, fasta_lines, distance_matrix, bisect_level, bisecting_documents, quintet_likelihood,
    fasta_by_language, taxonomy_files, root_files, alignment_files,
)}

# --- the same in SQL --------------------------------------------------------------------------------------------------

_SEQ = "s AS (SELECT doc_id AS seq_id, 'doc' || doc_id AS name, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq, lang, source, length(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS len FROM documents)"
_BENCH = "s AS (SELECT item_id AS seq_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM benchmark)"


def _sampled(k: int) -> str:
    return f"p AS (SELECT * FROM s ORDER BY md5('{SEED}:' || seq_id), seq_id LIMIT {k})"


def _jc(different: str, sites: str) -> str:
    return f"CASE WHEN {sites} < {S.MIN_SITES} THEN 1.0 WHEN {different} / {sites} >= {S.NEAR_ONE!r} THEN {S.SATURATED} ELSE abs(-0.75 * ln(1 - 4 * ({different} / {sites}) / 3)) END"


def _count(column: str, letter: str) -> str:
    return f"length({column}) - length(replace({column}, '{letter}', ''))"


_ORDERED_PAIRS = "q AS (SELECT x.seq_id AS i, y.seq_id AS j, x.seq AS a, y.seq AS b FROM p x, p y WHERE x.seq_id < y.seq_id)"
_SITES = "t AS (SELECT i, j, substr(a, k, 1) AS a, substr(b, k, 1) AS b FROM (SELECT i, j, a, b, unnest(range(1, least(length(a), length(b)) + 1)) AS k FROM q))"
_PAIR_D = f"d AS (SELECT q.i, q.j, {_jc('coalesce(u.different, 0)::DOUBLE', 'coalesce(u.sites, 0)')} AS d FROM q LEFT JOIN (SELECT i, j, count(*) FILTER (a <> b) AS different, count(*) AS sites FROM t WHERE a <> 'N' AND b <> 'N' GROUP BY i, j) u USING (i, j))"
_ASSIGNED = f"""{_SEQ},
    r AS (SELECT (row_number() OVER (ORDER BY lang) - 1)::BIGINT AS cluster_id, seq AS root FROM (SELECT lang, seq, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}:' || seq_id), seq_id) AS k FROM s WHERE len >= 100) WHERE k = 1),
    e AS (SELECT seq_id, cluster_id, substr(seq, k, 1) AS a, substr(root, k, 1) AS b FROM (SELECT seq_id, cluster_id, seq, root, unnest(range(1, least(length(seq), length(root)) + 1)) AS k FROM s, r)),
    u AS (SELECT seq_id, cluster_id, count(*) FILTER (a <> b) AS different, count(*) AS sites FROM e WHERE a <> 'N' AND b <> 'N' GROUP BY ALL),
    v AS (SELECT s.seq_id, r.cluster_id, {_jc('coalesce(u.different, 0)::DOUBLE', 'coalesce(u.sites, 0)')} AS d FROM s CROSS JOIN r LEFT JOIN u ON u.seq_id = s.seq_id AND u.cluster_id = r.cluster_id),
    g AS (SELECT seq_id, cluster_id, d, d < 1 AND d <= 0.75 AS is_assigned FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY d, cluster_id) AS k FROM v) WHERE k = 1)"""
_EVERY = sorted(set(S.PROTEIN_LETTERS + S.DNA_LETTERS))


def _score(known: str, others: float) -> str:
    return " + ".join(f"sum({_count('text', c)}) * {(math.log(S.KNOWN / len(known)) if c in known else math.log((1 - S.KNOWN) / others))!r}" for c in _EVERY)


_CHECKSUM = "coalesce(list_sum(list_transform(range(0, length(seq)), lambda i: ((i % 57) + 1) * ascii(substr(seq, (i + 1)::INT, 1)))), 0)::BIGINT % 10000"
_TREE = """z AS (SELECT count(*) AS z FROM customer), y AS (SELECT count(*) AS y FROM nation), x AS (SELECT count(*) AS x FROM region),
    lf AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS node, c_custkey AS label, c_nationkey AS up, (c_custkey * 7 % 5 + 1) / 8 AS bl FROM customer),
    na AS (SELECT z + row_number() OVER (ORDER BY n_nationkey) - 1 AS node, n_nationkey AS key, n_regionkey AS up, (n_nationkey * 11 % 23 + 1) / 8 AS bl FROM nation, z),
    re AS (SELECT z + y + row_number() OVER (ORDER BY r_regionkey) - 1 AS node, r_regionkey AS key, (r_regionkey * 3 % 4 + 1) / 8 AS bl FROM region, z, y),
    n(node, parent, bl, label) AS (SELECT lf.node, na.node, lf.bl, lf.label FROM lf JOIN na ON na.key = lf.up UNION ALL SELECT na.node, re.node, na.bl, NULL FROM na JOIN re ON re.key = na.up UNION ALL SELECT node, z + y + x, bl, NULL FROM re, z, y, x UNION ALL SELECT z + y + x, NULL, 0, NULL FROM z, y, x)"""
_UP = "up(node, steps, anc) AS (SELECT node, 0, node FROM n UNION ALL SELECT up.node, steps + 1, n.parent FROM up JOIN n ON n.node = up.anc WHERE n.parent IS NOT NULL)"
_ND = "nd AS (SELECT anc AS node, count(*) AS nd FROM up WHERE node < (SELECT z FROM z) GROUP BY anc), cut AS (SELECT n.node, bl FROM n JOIN nd USING (node) WHERE nd > 10 AND parent IS NOT NULL ORDER BY bl DESC, node LIMIT 7)"
_FROM_ROOT = "dr AS (SELECT up.node, sum(n.bl) AS dist, count(*) - 1 AS depth FROM up JOIN n ON n.node = up.anc GROUP BY up.node)"
_ALIGNED = "s AS (SELECT item_id AS seq_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM benchmark), p AS (SELECT seq_id, seq FROM s), w AS (SELECT max(length(seq)) AS w FROM p), m AS (SELECT seq_id, rpad(seq, (SELECT w FROM w)::INT, '-') AS aligned FROM p), c AS (SELECT k - 1 AS col, substr(aligned, k::INT, 1) AS x FROM (SELECT aligned, unnest(range(1, length(aligned) + 1)) AS k FROM m)), h AS (SELECT col, count(*) AS n, count(*) FILTER (x IN ('N', '-')) AS gaps, count(*) FILTER (x = 'A') AS ca, count(*) FILTER (x = 'C') AS cc, count(*) FILTER (x = 'G') AS cg, count(*) FILTER (x = 'T') AS ct FROM c GROUP BY col), k AS (SELECT * FROM h WHERE gaps <= n // 2)"
# All documents side by side: what is beyond a sequence's end is a gap, so only its own letters are counted.
_COLUMNS = f"{_SEQ}, c AS (SELECT k - 1 AS col, substr(seq, k::INT, 1) AS x FROM (SELECT seq, unnest(range(1, len + 1)) AS k FROM s)), h AS (SELECT col, (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM s) - count(*) FILTER (x <> 'N') AS gaps, count(*) FILTER (x = 'A') AS ca, count(*) FILTER (x = 'C') AS cc, count(*) FILTER (x = 'G') AS cg, count(*) FILTER (x = 'T') AS ct FROM c GROUP BY col), k AS (SELECT * FROM h WHERE gaps <= n // 2)"
_SEED_ROWS = " UNION ALL ".join("SELECT seq_id, " + f"'{x}:' || " + " || ".join(f"substr(z, (o + {i})::INT, 1)" for i in seed) + ", o FROM o" for x, seed in enumerate(S.SPACED_SEEDS))


def _aligned_sql(pairs: str, aligner: str, path: bool = False) -> str:
    """The dynamic program in SQL, an antidiagonal a step: ``al(i, j, score, different, sites)`` of the table ``pairs(i, j, a, b)``.

    Lists are by place in ``a``; a cell carries its cost and the sites on the path that ties lead to, and with ``path`` its
    moves too. For short sequences.
    """
    s = SCORINGS[aligner]
    moves = lambda value: f", 'p': {value}" if path else ""
    both, ext, far = s.opening + s.extending, s.extending, f"{{'c': 1000000000, 'd': 0, 's': 0{moves(repr(''))}}}"

    def gap(h: str, g: str, move: str, both: int = both, ext: int = ext) -> str:
        return f"CASE WHEN {h}.c + {both} <= {g}.c + {ext} THEN {{'c': {h}.c + {both}, 'd': {h}.d, 's': {h}.s{moves(f'{h}.p || {move!r}')}}} ELSE {{'c': {g}.c + {ext}, 'd': {g}.d, 's': {g}.s{moves(f'{g}.p || {move!r}')}}} END"

    x, y = "substr(a, i::INT, 1)", "substr(b, (d - i)::INT, 1)"
    known = f"({x} <> 'N' AND {y} <> 'N')"
    step = f"h2[i].p || CASE WHEN {x} = {y} THEN 'M' ELSE 'X' END"
    pair = f"{{'c': h2[i].c + CASE WHEN {x} = {y} THEN {s.match} ELSE {s.mismatch} END, 'd': h2[i].d + ({known} AND {x} <> {y})::INT, 's': h2[i].s + {known}::INT{moves(step)}}}"
    edge = moves("CASE WHEN i = 0 THEN repeat('I', d::INT) ELSE repeat('D', d::INT) END")
    zero = f"{{'c': 0, 'd': 0, 's': 0{moves(repr(''))}}}"
    best = "CASE WHEN q.c <= f[i + 1].c AND q.c <= e[i + 1].c THEN q WHEN f[i + 1].c <= e[i + 1].c THEN f[i + 1] ELSE e[i + 1] END"
    if s.gaps_first:
        best = "CASE WHEN e[i + 1].c <= f[i + 1].c AND e[i + 1].c <= q.c THEN e[i + 1] WHEN f[i + 1].c <= q.c THEN f[i + 1] ELSE q END"
    end, columns, old, second = f"{s.opening} + {ext} * d", "e1, f1", "e, f", ""
    places = "range(0, length(a) + 1)"
    if s.second is not None:
        both2, ext2 = sum(s.second), s.second[1]
        best = "list_filter([q, f[i + 1], e[i + 1], f2[i + 1], e2[i + 1]], lambda v: v.c = least(q.c, f[i + 1].c, e[i + 1].c, f2[i + 1].c, e2[i + 1].c))[1]"
        end, columns, old = f"least({end}, {s.second[0]} + {ext2} * d)", "e1, f1, e21, f21", "e, f, e2, f2"
        second = f""",
                list_transform({places}, lambda i: CASE WHEN d + 1 - i < 1 OR d + 1 - i > m THEN {far} ELSE {gap("h1[i + 1]", "e21[i + 1]", "I", both2, ext2)} END) AS e2,
                list_transform({places}, lambda i: CASE WHEN i < 1 OR i > d + 1 OR d + 1 - i > m THEN {far} ELSE {gap("h1[i]", "f21[i]", "D", both2, ext2)} END) AS f2"""
    none = f"list_transform({places}, lambda i: {far})"
    program = f"""dp(i_, j_, a, b, n, m, d, h1, h2, {columns}) AS (
        SELECT i, j, a, b, length(a), length(b), 0, list_transform({places}, lambda i: CASE WHEN i = 0 THEN {zero} ELSE {far} END), {none}, {", ".join([none] * (2 if s.second is None else 4))} FROM {pairs}
        UNION ALL
        SELECT i_, j_, a, b, n, m, d, list_transform({places}, lambda i: CASE WHEN i > d OR d - i > m THEN {far} WHEN i = 0 OR i = d THEN {{'c': {"0" if s.free_ends else end}, 'd': 0, 's': 0{edge}}} ELSE list_transform([{pair}], lambda q: {best})[1] END), h1, {old}
        FROM (SELECT i_, j_, a, b, n, m, d + 1 AS d, h1, h2,
                list_transform({places}, lambda i: CASE WHEN d + 1 - i < 1 OR d + 1 - i > m THEN {far} ELSE {gap("h1[i + 1]", "e1[i + 1]", "I")} END) AS e,
                list_transform({places}, lambda i: CASE WHEN i < 1 OR i > d + 1 OR d + 1 - i > m THEN {far} ELSE {gap("h1[i]", "f1[i]", "D")} END) AS f{second}
            FROM dp WHERE d < n + m))"""
    last = "SELECT i_, j_, h1[n + 1] AS x FROM dp WHERE d = n + m"
    if s.free_ends:  # the last best place of the last column, else of the last row
        last = """SELECT i_, j_, arg_min(x, {'c': x.c, 'w': w, 'p': -p}) AS x FROM (
            SELECT i_, j_, 0 AS w, d - m AS p, h1[d - m + 1] AS x FROM dp WHERE d >= m AND d - m <= n
            UNION ALL SELECT i_, j_, 1, d - n, h1[n + 1] FROM dp WHERE d >= n AND d - n <= m) GROUP BY ALL"""
    return f"{program}, al AS (SELECT i_ AS i, j_ AS j, (x.c * {s.sign})::INT AS score, x.d::INT AS different, x.s::INT AS sites{", x.p AS path" if path else ""} FROM ({last}))"


_BENCH_SEQ = "s AS (SELECT item_id AS seq_id, 'doc' || item_id AS name, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM benchmark), p AS (SELECT seq_id, seq FROM s)"
_BENCH_PAIRS = f"{_BENCH_SEQ}, {_ORDERED_PAIRS}"
# An item with every root: a is the root, as in the operator.
_BENCH_ASSIGNED = f"""{_BENCH_SEQ}, r AS (SELECT (row_number() OVER (ORDER BY seq_id) - 1)::BIGINT AS cluster_id, seq FROM (SELECT * FROM s ORDER BY md5('{SEED}:' || seq_id), seq_id LIMIT 4)),
    k AS (SELECT r.cluster_id AS i, s.seq_id AS j, r.seq AS a, s.seq AS b FROM s, r), {_aligned_sql("k", "affine")},
    g AS (SELECT seq_id, cluster_id, d, d < 1 AND d <= 0.75 AS is_assigned FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY d, cluster_id) AS k FROM (SELECT j AS seq_id, i AS cluster_id, {_jc("different::DOUBLE", "sites")} AS d FROM al)) WHERE k = 1)"""
_ANCHORS = f"a AS (SELECT vec_id AS anchor_id, embedding AS anchor FROM embeddings ORDER BY md5('{SEED}:' || vec_id), vec_id LIMIT 4), d AS (SELECT e.vec_id, a.anchor_id, e.embedding, sqrt(list_sum(list_transform(list_zip(e.embedding, a.anchor), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM embeddings e, a)"


def _gapped_sql(seq: str, gap: str) -> str:
    return f"array_to_string(list_transform(range(1, length(path) + 1), lambda k: CASE WHEN substr(path, k::INT, 1) = '{gap}' THEN '-' ELSE substr({seq}, length(replace(left(path, k::INT), '{gap}', ''))::INT, 1) END), '')"


def _far(x: str, y: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


ORACLES = {
    "seq_stats": f"WITH {_SEQ} SELECT count(*) AS n, max(len)::INT AS max_len, min(len)::INT AS min_len, max(length(name))::INT AS max_name FROM s",
    "seq_length_filter": f"WITH {_SEQ} SELECT seq_id, len::INT AS len FROM s WHERE len BETWEEN 100 AND 6000",
    "base_composition": f"WITH {_SEQ} SELECT lang, {', '.join(f'sum({_count("seq", b)})::BIGINT AS n_{b.lower()}' for b in 'ACGTN')} FROM s GROUP BY lang",
    "base_code_counts": f"WITH {_SEQ} SELECT source, {', '.join(f'sum({_count("seq", b)})::BIGINT AS code_{i}' for i, b in enumerate('ACGTN'))} FROM s GROUP BY source",
    "alphabet_detect": f"SELECT lang, ({' + '.join(f'sum({_count("text", c)})' for c in _EVERY)})::BIGINT AS letters, CASE WHEN {_score(S.DNA_LETTERS, 116.0)} > {_score(S.PROTEIN_LETTERS, 88.0)} THEN 'dna' WHEN {_score(S.DNA_LETTERS, 116.0)} < {_score(S.PROTEIN_LETTERS, 88.0)} THEN 'protein' ELSE 'unknown' END AS alphabet FROM documents GROUP BY lang",
    "gcg_checksum": f"WITH {_SEQ} SELECT seq_id, {_CHECKSUM} AS checksum FROM s",
    "fasta_column": f"WITH {_SEQ} SELECT seq_id, place::INT AS place, CASE WHEN place = 0 THEN name ELSE 'tail of ' || name END AS name, {_CHECKSUM} AS checksum FROM s, range(2) x(place)",
    "sample_k": f"WITH {_SEQ}, {_sampled(50)} SELECT seq_id, len::INT AS len FROM p",
    "sample_semi": f"WITH {_SEQ}, {_sampled(50)} SELECT seq_id, name FROM s WHERE seq_id IN (SELECT seq_id FROM p)",
    "remaining_anti": f"WITH {_SEQ}, {_sampled(50)} SELECT seq_id, name FROM s WHERE seq_id NOT IN (SELECT seq_id FROM p)",
    "random_member": f"WITH {_SEQ} SELECT cluster_id, seq_id FROM (SELECT source AS cluster_id, seq_id, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || seq_id), seq_id) AS k FROM s) WHERE k = 1",
    "pair_count": f"WITH {_SEQ} SELECT lang, count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM s GROUP BY lang",
    "site_patterns": f"WITH {_BENCH_PAIRS}, {_SITES} SELECT i, j, a, b, count(*) AS n FROM t GROUP BY ALL",
    "jc_distance": f"WITH {_BENCH_PAIRS}, {_SITES}, {_PAIR_D} SELECT i, j, round(d, 6) AS d FROM d",
    "edit_distance_pairs": f"WITH {_BENCH_PAIRS} SELECT i, j, levenshtein(a, b)::BIGINT AS d FROM q",
    "align_edit_score": f"WITH {_BENCH_PAIRS} SELECT i, j, levenshtein(a, b)::BIGINT AS d FROM q",
    "mean_between_groups": f"WITH {_BENCH_PAIRS}, {_SITES}, {_PAIR_D}, y AS (SELECT seq_id, instr('ACGT', left(seq, 1)) AS c FROM p WHERE seq <> '' UNION ALL SELECT seq_id, 1 FROM p WHERE seq = '') SELECT round(avg(m), 6) AS mean FROM (SELECT avg(d.d) AS m FROM d JOIN y a ON a.seq_id = d.i JOIN y b ON b.seq_id = d.j WHERE a.c <> b.c GROUP BY least(a.c, b.c), greatest(a.c, b.c))",
    "nearest_root_assign": f"WITH {_ASSIGNED} SELECT seq_id, cluster_id, round(d, 6) AS d, is_assigned FROM g",
    "saved_for_later": f"WITH {_ASSIGNED} SELECT seq_id FROM g WHERE NOT is_assigned",
    "cluster_sizes": f"WITH {_ASSIGNED} SELECT cluster_id, count(*) AS n FROM g GROUP BY cluster_id",
    "largest_cluster": f"WITH {_ASSIGNED} SELECT cluster_id, count(*) AS n FROM g GROUP BY cluster_id ORDER BY n DESC, cluster_id LIMIT 1",
    "size_cv": f"WITH {_ASSIGNED} SELECT round(stddev_pop(n) / avg(n), 6) AS cv FROM (SELECT count(*) AS n FROM g GROUP BY cluster_id)",
    "nmi_vs_taxonomy": f"""WITH {_ASSIGNED}, x AS (SELECT cluster_id AS c, lang AS t, count(*)::DOUBLE AS n FROM g JOIN s USING (seq_id) GROUP BY ALL), z AS (SELECT sum(n) AS z FROM x),
        c AS (SELECT c, sum(n) AS nc FROM x GROUP BY c), t AS (SELECT t, sum(n) AS nt FROM x GROUP BY t)
        SELECT round(2 * (SELECT sum(n / z * ln(n * z / (nc * nt))) FROM x JOIN c USING (c) JOIN t USING (t), z) / ((SELECT -sum(nc / z * ln(nc / z)) FROM c, z) + (SELECT -sum(nt / z * ln(nt / z)) FROM t, z)), 6) AS nmi""",
    "taxonomy_join": "SELECT d.doc_id AS seq_id, 'doc' || d.doc_id AS name, coalesce(l.quality::VARCHAR, '(null)') AS taxon FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "clstr_lines": f"WITH {_ASSIGNED}, y AS (SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY seq_id) - 1)::INT AS pos, len, name FROM g JOIN s USING (seq_id)) SELECT cluster_id, pos, pos || chr(9) || len || 'nt, >' || name || '...' AS line FROM y UNION ALL SELECT DISTINCT cluster_id, -1, '>Cluster ' || cluster_id FROM g",
    "length_summary": f"WITH {_SEQ} SELECT count(*) AS n, round(avg(len), 6) AS mean, round(stddev_samp(len), 6) AS sd, {', '.join(f'count(*) FILTER (len >= {i * 200} AND len < {(i + 1) * 200}) AS bin{i}' for i in range(10))} FROM s",
    "dup_names": f"WITH {_SEQ} SELECT name, count(*) AS n, count(DISTINCT c) AS checksums FROM (SELECT source || '/' || lang AS name, {_CHECKSUM} AS c FROM s) GROUP BY name HAVING count(*) > 1",
    "unique_names": f"WITH {_SEQ} SELECT seq_id, CASE WHEN k > 0 THEN name || '_' || k ELSE name END AS name FROM (SELECT seq_id, source || '/' || lang AS name, row_number() OVER (PARTITION BY source || '/' || lang ORDER BY seq_id) - 1 AS k FROM s)",
    "dense_ranks": f"WITH {_SEQ} SELECT seq_id, len::INT AS len, row_number() OVER (ORDER BY len, seq_id) - 1 AS rank FROM s",
    "top_branches": f"WITH RECURSIVE {_TREE}, {_UP}, {_ND} SELECT node::INT AS node_id, bl::DOUBLE AS bl FROM cut",
    "nearest_cut": f"WITH RECURSIVE {_TREE}, {_UP}, {_ND}, f AS (SELECT up.node, arg_min(anc, steps) AS anc FROM up JOIN cut ON cut.node = up.anc GROUP BY up.node) SELECT n.label::BIGINT AS seq_id, coalesce(f.anc, -1)::INT AS cut_node FROM n LEFT JOIN f ON f.node = n.node WHERE n.label IS NOT NULL",
    "tree_labels": f"WITH RECURSIVE {_TREE}, {_UP}, {_ND}, {_FROM_ROOT} SELECT node::INT AS node_id, nd, depth, round(dist::DOUBLE, 6) AS dist_root FROM nd JOIN dr USING (node)",
    "common_ancestors": f"WITH RECURSIVE {_TREE}, {_UP}, {_FROM_ROOT}, l AS (SELECT x.node AS a, y.node AS b, arg_min(x.anc, x.steps) AS lca FROM up x JOIN up y ON x.anc = y.anc AND y.node = x.node + 1 WHERE y.node < (SELECT z FROM z) GROUP BY ALL) SELECT a::INT AS a, b::INT AS b, lca::INT AS lca, round((x.dist + y.dist - 2 * z.dist)::DOUBLE, 6) AS distance FROM l JOIN dr x ON x.node = a JOIN dr y ON y.node = b JOIN dr z ON z.node = lca",
    "gapped_columns": f"WITH {_ALIGNED} SELECT 0::BIGINT AS cluster_id, col::INT AS col, n, gaps FROM k",
    "consensus_base": f"WITH {_ALIGNED} SELECT 0::BIGINT AS cluster_id, string_agg(CASE WHEN greatest(ca, cc, cg, ct) = 0 THEN 'N' WHEN ca = greatest(ca, cc, cg, ct) THEN 'A' WHEN cc = greatest(ca, cc, cg, ct) THEN 'C' WHEN cg = greatest(ca, cc, cg, ct) THEN 'G' ELSE 'T' END, '' ORDER BY col) AS consensus FROM k",
    "spaced_seed_roots": f"WITH {_ASSIGNED}, o AS (SELECT seq_id, replace(seq, 'N', 'A') AS z, unnest(range(1, length(seq) - 4)) AS o FROM s), x AS (SELECT seq_id, code, o FROM ({_SEED_ROWS}) y(seq_id, code, o)), ro AS (SELECT cluster_id AS seq_id, replace(root, 'N', 'A') AS z, unnest(range(1, length(root) - 4)) AS o FROM r), rx AS (SELECT seq_id, code, o FROM ({_SEED_ROWS.replace('FROM o', 'FROM ro')}) y(seq_id, code, o)), h AS (SELECT x.seq_id AS i, rx.seq_id AS j, rx.o - x.o AS g, count(*) AS n FROM x JOIN rx ON x.code = rx.code GROUP BY ALL HAVING count(*) > 61.08) SELECT s.seq_id AS i, r.cluster_id AS j, coalesce(sum(h.n), 0)::BIGINT AS similarity FROM s CROSS JOIN r LEFT JOIN h ON h.i = s.seq_id AND h.j = r.cluster_id GROUP BY ALL",
    "spaced_seed_similarity": f"WITH {_BENCH_SEQ}, o AS (SELECT seq_id, replace(seq, 'N', 'A') AS z, unnest(range(1, length(seq) - 4)) AS o FROM p), e(seq_id, code, o) AS ({_SEED_ROWS}), g AS (SELECT x.seq_id AS i, y.seq_id AS j, y.o - x.o AS g, count(*) AS n FROM e x JOIN e y ON x.code = y.code AND x.seq_id < y.seq_id GROUP BY ALL HAVING count(*) > 61.08) SELECT x.seq_id AS i, y.seq_id AS j, coalesce(sum(g.n), 0)::BIGINT AS similarity FROM p x JOIN p y ON x.seq_id < y.seq_id LEFT JOIN g ON g.i = x.seq_id AND g.j = y.seq_id GROUP BY ALL",
    "anchors_by_length": f"WITH {_SEQ}, c AS (SELECT count(*) AS n, least(32, count(*)) AS k FROM s) SELECT seq_id, len::INT AS len, rank FROM (SELECT seq_id, len, row_number() OVER (ORDER BY len DESC, seq_id) - 1 AS rank FROM s), c WHERE rank % (n // k) = 0 AND rank < (n // k) * k",
    "euclid_to_anchor": f"WITH {_ANCHORS} SELECT vec_id, anchor_id, round(d, 5) AS d FROM d",
    "kmeans_one_step": f"WITH {_ANCHORS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, anchor_id) AS k FROM d) WHERE k = 1), x AS (SELECT anchor_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM b) SELECT anchor_id AS centre_id, count(*) AS n, dim::INT AS dim, round(avg(x), 5) AS x FROM x GROUP BY anchor_id, dim",
    "cigar_ops": f"WITH RECURSIVE {_BENCH_PAIRS}, {_aligned_sql('q', 'affine', True)}, r AS (SELECT i, j, left(run, 1) AS op, length(run) AS n FROM (SELECT i, j, unnest(regexp_extract_all(path, 'M+|X+|I+|D+')) AS run FROM al)), z AS (SELECT i, j, sum(CASE op WHEN 'M' THEN 0 WHEN 'X' THEN 4 * n ELSE 6 + 2 * n END)::BIGINT AS affine, sum(CASE op WHEN 'M' THEN 0 WHEN 'X' THEN 4 * n ELSE least(6 + 2 * n, 24 + n) END)::BIGINT AS affine2, sum(CASE op WHEN 'M' THEN 0 WHEN 'X' THEN 4 * n ELSE 2 * n END)::BIGINT AS linear, coalesce(sum(n) FILTER (op = 'M'), 0)::BIGINT AS matches, coalesce(sum(n) FILTER (op <> 'M'), 0)::BIGINT AS edits FROM r GROUP BY ALL), g AS (SELECT i, j, {_gapped_sql('a', 'I')} AS x, {_gapped_sql('b', 'D')} AS y FROM al JOIN q USING (i, j)) SELECT i, j, coalesce(matches, 0) AS matches, coalesce(edits, 0) AS edits, coalesce(linear, 0) AS linear, coalesce(affine, 0) AS affine, coalesce(affine2, 0) AS affine2, x, y, true AS valid FROM g LEFT JOIN z USING (i, j)",
    "stream_assign": f"WITH {_ASSIGNED} SELECT seq_id, cluster_id, round(d, 6) AS d, is_assigned FROM g",
    "distance_matrix": f"WITH RECURSIVE {_BENCH_PAIRS}, {_aligned_sql('q', 'affine')}, d AS (SELECT i, j, {_jc('different::DOUBLE', 'sites')} AS d FROM al), b AS (SELECT i, j, d FROM d UNION ALL SELECT j, i, d FROM d UNION ALL SELECT seq_id, seq_id, 0 FROM s), z AS (SELECT seq_id AS j, row_number() OVER (ORDER BY seq_id) - 1 AS z FROM s) SELECT i, (z // 16)::INT AS block, {', '.join(f'round(max(d) FILTER (z % 16 = {k}), 6) AS c{k}' for k in range(16))} FROM b JOIN z USING (j) GROUP BY ALL",
    "bisect_level": f"""WITH v AS (SELECT vec_id AS seq_id, label::VARCHAR AS node, embedding::DOUBLE[] AS x FROM embeddings),
        e AS (SELECT seq_id, node, unnest(x) AS y, unnest(range(0, len(x))) AS k FROM v),
        m AS (SELECT node, list(y ORDER BY k) AS c FROM (SELECT node, k, avg(y) AS y FROM e GROUP BY ALL) GROUP BY node),
        f1 AS (SELECT node, x AS one FROM v JOIN m USING (node) QUALIFY row_number() OVER (PARTITION BY node ORDER BY {_far("x", "c")} DESC, seq_id) = 1),
        f2 AS (SELECT node, one, x AS two FROM v JOIN f1 USING (node) QUALIFY row_number() OVER (PARTITION BY node ORDER BY {_far("x", "one")} DESC, seq_id) = 1),
        n AS (SELECT seq_id, node, {_far("x", "two")} < {_far("x", "one")} AS side FROM v JOIN f2 USING (node))
        SELECT seq_id, node, CASE WHEN bool_or(side) OVER w AND NOT bool_and(side) OVER w THEN side ELSE row_number() OVER (PARTITION BY node ORDER BY seq_id) - 1 >= count(*) OVER w // 2 END AS side FROM n WINDOW w AS (PARTITION BY node)""",
    "quintet_likelihood": f"""WITH {_ASSIGNED},
        w AS (SELECT max(root) FILTER (cluster_id = 0) AS r0, max(root) FILTER (cluster_id = 1) AS r1, max(root) FILTER (cluster_id = 2) AS r2, max(root) FILTER (cluster_id = 3) AS r3 FROM r),
        y AS (SELECT {", ".join(f"CASE WHEN substr(r{x}, k::INT, 1) = '' THEN 'N' ELSE substr(r{x}, k::INT, 1) END AS l{x}" for x in range(4))}, substr(seq, k::INT, 1) AS l4 FROM (SELECT seq, unnest(range(1, len + 1)) AS k FROM s), w),
        pat AS (SELECT l0, l1, l2, l3, l4, count(*) AS n FROM y GROUP BY ALL),
        b(x) AS (VALUES ('A'), ('C'), ('G'), ('T')), o(x) AS (SELECT x FROM b UNION ALL VALUES ('N')),
        f(k, x, pi) AS (VALUES {", ".join(f"({k}, '{x}', {(*f, 1.0)[i] / (sum(f) + 1)!r}::DOUBLE)" for k, f in enumerate(FREQUENCIES) for i, x in enumerate("ACGT"))}),
        t(br, t) AS (VALUES {", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in enumerate(BRANCHES))}),
        p AS (SELECT k, br, b.x AS u, o.x AS v, CASE WHEN o.x = 'N' THEN 1 ELSE CASE WHEN b.x = o.x THEN exp(-t) ELSE 0 END + (1 - exp(-t)) * pi END AS p FROM b, o, t, f WHERE f.x = o.x OR (o.x = 'N' AND f.x = 'A')),
        m5 AS (SELECT p.k, p.u AS s, x.v AS a, y.v AS b, sum(p.p * x.p * y.p) AS m FROM p JOIN p x ON x.k = p.k AND x.br = 0 AND x.u = p.v JOIN p y ON y.k = p.k AND y.br = 1 AND y.u = p.v WHERE p.br = 5 AND p.v <> 'N' GROUP BY ALL),
        m6 AS (SELECT p.k, p.u AS s, x.v AS a, y.v AS b, sum(p.p * x.p * y.p) AS m FROM p JOIN p x ON x.k = p.k AND x.br = 2 AND x.u = p.v JOIN p y ON y.k = p.k AND y.br = 3 AND y.u = p.v WHERE p.br = 6 AND p.v <> 'N' GROUP BY ALL),
        m7 AS (SELECT p.k, p.u AS s, l0, l1, l2, l3, l4, n, sum(p.p * m5.m * m6.m) AS m FROM pat JOIN p ON p.br = 7 AND p.v <> 'N' JOIN m5 ON m5.k = p.k AND m5.s = p.v AND m5.a = l0 AND m5.b = l1 JOIN m6 ON m6.k = p.k AND m6.s = p.v AND m6.a = l2 AND m6.b = l3 GROUP BY ALL),
        l AS (SELECT m7.k, l0, l1, l2, l3, l4, n, sum(f.pi * m7.m * p.p) AS l FROM m7 JOIN f ON f.k = m7.k AND f.x = m7.s JOIN p ON p.k = m7.k AND p.br = 4 AND p.u = m7.s AND p.v = l4 GROUP BY ALL)
        SELECT k::INT AS k, round(sum(n * ln(l)), 2) AS loglik FROM l GROUP BY k""",
    "stream_pool": f"WITH {_ASSIGNED} SELECT seq_id, s.len::INT AS len, round(d, 6) AS d FROM g JOIN s USING (seq_id) WHERE NOT is_assigned",
    "fasta_source": f"WITH {_SEQ} SELECT name, len::INT AS len, {_CHECKSUM} AS checksum FROM s",
    "fasta_lines": f"WITH {_SEQ}, t AS (SELECT seq_id, 0 AS place, name, seq FROM s UNION ALL SELECT seq_id, 1, 'end of ' || name, '' FROM s) SELECT seq_id, place::INT AS place, name, {_CHECKSUM} AS checksum FROM t",
    "seed_counts": f"WITH {_SEQ}, o AS (SELECT lang AS seq_id, replace(seq, 'N', 'A') AS z, unnest(range(1, length(seq) - 4)) AS o FROM s), e(lang, code, o) AS ({_SEED_ROWS}) SELECT lang, ({' + '.join(f'{4**(4-k)} * (instr({chr(39)}ACGT{chr(39)}, substr(code, {k+3}, 1)) - 1)' for k in range(5))} + 1024 * left(code, 1)::INT)::INT AS code, count(*) AS n, (min(o) - 1)::INT AS place FROM e GROUP BY ALL",
    "cigar_lengths": f"WITH RECURSIVE {_BENCH_PAIRS}, {_aligned_sql('q', 'affine', True)}, r AS (SELECT i, j, path, unnest(regexp_extract_all(path, 'M+|X+|I+|D+')) AS run FROM al), u AS (SELECT i, j, left(run, 1) AS op, sum(length(run))::BIGINT AS n, count(*) AS runs FROM r GROUP BY ALL), v AS (SELECT i, j, path, unnest(['M', 'X', 'I', 'D']) AS op FROM al), w AS (SELECT i, j, op, left(path, (instr(path, op) - 1)::INT) AS before FROM v WHERE instr(path, op) > 0) SELECT i, j, op, n, runs, length(replace(before, 'I', ''))::BIGINT AS a_start, length(replace(before, 'D', ''))::BIGINT AS b_start FROM u JOIN w USING (i, j, op)",
    "fasta_by_language": f"WITH {_SEQ} SELECT coalesce(lang, 'none') AS lang, name, len::INT AS len, {_CHECKSUM} AS checksum FROM s",
    "taxonomy_files": f"""WITH {_SEQ}, l AS (SELECT seq_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), len % 10) AS name, concat_ws(';', lang, source, name) AS lineage FROM s)
        SELECT name, arg_min(lineage, seq_id) AS lineage, len(string_split(arg_min(lineage, seq_id), ';'))::INT AS n_ranks FROM l GROUP BY name""",
    "root_files": f"WITH {_ASSIGNED}, w AS (SELECT CASE WHEN length(root) % 2 = 0 THEN 'random' ELSE '' END || cluster_id AS name, root AS seq FROM r) SELECT name, length(seq)::INT AS len, {_CHECKSUM} AS checksum FROM w",
    "alignment_files": f"""WITH {_BENCH}, w AS (SELECT 'doc' || seq_id AS name, rpad(seq, (SELECT max(length(seq)) FROM s)::INT, '-') AS seq FROM s)
        SELECT unnest(['clustal', 'msf', 'fasta']) AS format, CASE WHEN (SELECT count(*) FROM w WHERE contains(seq, '-')) > 0 THEN 'aligned' ELSE 'maybe' END AS state, name, length(seq)::INT AS len, {_CHECKSUM} AS checksum FROM w""",
    "affine_pairs": f"WITH RECURSIVE {_BENCH_PAIRS}, {_aligned_sql('q', 'affine')} SELECT i, j, score, different, sites, score::BIGINT AS cigar_cost FROM al",
    "affine2_pairs": f"WITH RECURSIVE {_BENCH_PAIRS}, h AS (SELECT i, j, a, b FROM q UNION ALL SELECT seq_id, -seq_id - 1, seq, left(seq, (length(seq) // 2)::INT) || seq || substr(seq, (length(seq) // 2 + 1)::INT) FROM s), {_aligned_sql('h', 'affine2')} SELECT i, j, score, different, sites, score::BIGINT AS cigar_cost FROM al",
    "nw_pairs": f"WITH RECURSIVE {_BENCH_PAIRS}, {_aligned_sql('q', 'nw')} SELECT i, j, score, different, sites FROM al",
    "capped_pairs": f"WITH RECURSIVE {_BENCH_PAIRS}, {_aligned_sql('q', 'affine')} SELECT i, j, score, different, sites FROM al WHERE score <= {MOST}",
    "affine_assign": f"WITH RECURSIVE {_BENCH_ASSIGNED} SELECT seq_id, cluster_id, round(d, 6) AS d, is_assigned FROM g",
    "affine_sizes": f"WITH RECURSIVE {_BENCH_ASSIGNED} SELECT cluster_id, count(*) AS n FROM g GROUP BY cluster_id",
    "affine_largest": f"WITH RECURSIVE {_BENCH_ASSIGNED} SELECT cluster_id, count(*) AS n FROM g GROUP BY cluster_id ORDER BY n DESC, cluster_id LIMIT 1",
    "affine_cv": f"WITH RECURSIVE {_BENCH_ASSIGNED} SELECT round(stddev_pop(n) / avg(n), 6) AS cv FROM (SELECT count(*) AS n FROM g GROUP BY cluster_id)",
    "affine_report": f"WITH RECURSIVE {_BENCH_ASSIGNED}, y AS (SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY seq_id) - 1)::INT AS pos, length(seq) AS len, name FROM g JOIN s USING (seq_id)) SELECT cluster_id, pos, pos || chr(9) || len || 'nt, >' || name || '...' AS line FROM y UNION ALL SELECT DISTINCT cluster_id, -1, '>Cluster ' || cluster_id FROM g",
    "affine_mean_between": f"WITH RECURSIVE {_BENCH_ASSIGNED}, {_ORDERED_PAIRS}, {_aligned_sql('q', 'affine').replace('dp', 'dq').replace('al AS', 'aq AS')}, d AS (SELECT i, j, {_jc('different::DOUBLE', 'sites')} AS d FROM aq) SELECT round(avg(m), 6) AS mean FROM (SELECT avg(d.d) AS m FROM d JOIN g x ON x.seq_id = d.i JOIN g y ON y.seq_id = d.j WHERE x.cluster_id <> y.cluster_id GROUP BY least(x.cluster_id, y.cluster_id), greatest(x.cluster_id, y.cluster_id))",
    "site_patterns_roots": f"WITH {_ASSIGNED} SELECT seq_id AS i, cluster_id AS j, a, b, count(*) AS n FROM e GROUP BY ALL",
    "jc_distance_roots": f"WITH {_ASSIGNED} SELECT seq_id AS i, cluster_id AS j, round(d, 6) AS d FROM v",
    "mean_between_roots": f"WITH {_ASSIGNED}, l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS c FROM (SELECT DISTINCT lang FROM s WHERE len >= 100)) SELECT round(avg(m), 6) AS mean FROM (SELECT avg(d) AS m FROM v JOIN s USING (seq_id) JOIN l USING (lang) WHERE l.c <> v.cluster_id GROUP BY least(l.c, v.cluster_id), greatest(l.c, v.cluster_id))",
    "gapped_columns_all": f"WITH {_COLUMNS} SELECT 0::BIGINT AS cluster_id, col::INT AS col, n, gaps FROM k",
    "consensus_base_all": f"WITH {_COLUMNS} SELECT 0::BIGINT AS cluster_id, string_agg(CASE WHEN greatest(ca, cc, cg, ct) = 0 THEN 'N' WHEN ca = greatest(ca, cc, cg, ct) THEN 'A' WHEN cc = greatest(ca, cc, cg, ct) THEN 'C' WHEN cg = greatest(ca, cc, cg, ct) THEN 'G' ELSE 'T' END, '' ORDER BY col) AS consensus FROM k",
}
