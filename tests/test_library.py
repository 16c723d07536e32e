"""Sources, sinks, relational operators and whole runs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cladeforge.functions import sequence as S
from cladeforge.functions.alignment import aligned
from cladeforge.operators import clusters, distances, sampling, trees
from cladeforge.plans import clustering
from cladeforge.sources import files
from cladeforge.streaming import assigning


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nacgt\nNN\n>two\r\nGG\r\nTT\r\n>three\n>four\nAC-GT\n")
    got = files.read_fasta(spark, str(tmp_path / "a.fa"))
    rows = [(r.seq_id, r.name, r.seq, r.len) for r in got.orderBy("seq_id").collect()]
    assert rows == [(0, "one first", "ACGTNN", 6), (1, "two", "GGTT", 4), (2, "three", "", 0), (3, "four", "AC-GT", 5)]
    files.write_fasta(got, str(tmp_path / "out"))
    again = files.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.name, r.seq) for r in again.collect()) == sorted((n, s) for _, n, s, _ in rows)
    files.write_fasta(got.withColumn("cluster_id", F.col("seq_id") % 2), str(tmp_path / "by"), "cluster_id")
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["cluster_id=0", "cluster_id=1"]
    assert files.statistics(got).first().asDict() == {"n": 4, "max_len": 6, "min_len": 0, "max_name": 9}


def test_gzip_and_many_files_keep_dense_ranks(spark, tmp_path):
    import gzip

    for k in range(3):
        with gzip.open(tmp_path / f"{k}.fa.gz", "wt") as f:
            f.write("".join(f">s{k}_{i}\nACGT\n" for i in range(5)))
    got = files.read_fasta(spark, str(tmp_path)).orderBy("seq_id").collect()
    assert [r.seq_id for r in got] == list(range(15)) and [r.name for r in got] == [f"s{k}_{i}" for k in range(3) for i in range(5)]


def test_taxonomy_first_value_stays(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tD;P;C\nb\tD;Q\na\tX;Y\nbroken\n")
    got = {r.name: (r.lineage, r.ranks) for r in files.read_taxonomy(spark, str(tmp_path / "t.tsv")).collect()}
    assert got == {"a": ("D;P;C", ["D", "P", "C"]), "b": ("D;Q", ["D", "Q"])}


def test_report_roots_and_names(spark, tmp_path):
    members = spark.createDataFrame([(0, 5, "x", 4), (0, 2, "y", 3), (1, 7, "z", 9)], "cluster_id long, seq_id long, name string, len int")
    files.write_clstr(members, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*")))
    assert text == ">Cluster 0\n0\t3nt, >y...\n1\t4nt, >x...\n>Cluster 1\n0\t9nt, >z...\n"
    roots = spark.createDataFrame([(0, "ACGT", False), (1, "GG", True)], "cluster_id long, root_seq string, random boolean")
    files.write_roots(roots, str(tmp_path / "r"))
    assert sorted(r.name for r in files.read_fasta(spark, str(tmp_path / "r")).collect()) == ["0", "random1"]
    named = spark.createDataFrame([(0, "a", "AC"), (1, "a", "AC"), (2, "b", "AC"), (3, "a", "GT")], "seq_id long, name string, seq string")
    assert [r.name for r in files.unique_names(named).orderBy("seq_id").collect()] == ["a", "a_1", "b", "a_2"]
    assert [(r.name, r.n, r.checksums) for r in files.duplicate_names(named).collect()] == [("a", 3, 2)]


@pytest.mark.parametrize("kind", ["clustal", "msf"])
def test_alignment_files_round_trip(spark, tmp_path, kind):
    msa = spark.createDataFrame([("a", "ACGT-" * 30), ("b", "AC-TT" * 30)], "name string, aligned string")
    lines = [r.line for r in files.alignment_lines(msa, kind).orderBy("part", "pos").collect()]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    read = files.read_clustal if kind == "clustal" else files.read_msf
    assert {r.name: r.aligned for r in read(spark, str(tmp_path / "x.txt")).collect()} == {"a": "ACGT-" * 30, "b": "AC-TT" * 30}


def test_newick(spark):
    tree = spark.createDataFrame([(0, 3, 1.0, "a"), (1, 3, 2.0, "b"), (2, 4, 0.5, "c"), (3, 4, 0.25, None), (4, None, 0.0, None)], "node_id int, parent int, bl double, label string")
    assert files.newick(tree) == "(c:0.5,(a:1,b:2):0.25);"


def test_jukes_cantor(spark):
    rows = [(0, 10), (1, 10), (8, 10), (3, 4), (0, 0)]
    got = [r.d for r in spark.createDataFrame(rows, "x int, n int").select("x", "n", S.jukes_cantor(F.col("x"), F.col("n")).alias("d")).collect()]
    assert [round(d, 6) for d in got] == [0, 0.107326, 30, 1, 1]


def test_cigar_validity_and_checksum(spark):
    rows = [("2M1X", "ACG", "ACT", True), ("3M", "ACG", "ACT", False), ("2M", "ACG", "AC", False), ("2M1D", "ACG", "AC", True), ("xM", "A", "A", False)]
    frame = spark.createDataFrame(rows, "c string, a string, b string, ok boolean")
    assert all(r.ok == r.got for r in frame.withColumn("got", S.cigar_is_valid(F.col("c"), F.col("a"), F.col("b"))).collect())
    text = "ACGT" * 20
    got = spark.createDataFrame([(text,)], "s string").select(S.gcg_checksum(F.col("s"))).first()[0]
    assert got == sum((i % 57 + 1) * ord(c) for i, c in enumerate(text)) % 10000


def test_aligned_handles_nulls_and_empty(spark):
    rows = [("ACGT", "ACT"), (None, "A"), ("A", None), ("", ""), ("", "AC")]
    got = aligned(spark.createDataFrame(rows, "a string, b string")).collect()
    assert [None if r.alignment is None else (r.alignment.score, r.alignment.cigar) for r in got] == [(8, "2M1D1M"), None, None, (0, ""), (10, "2I")]
    assert aligned(spark.createDataFrame([], "a string, b string")).collect() == []


def test_sample_and_anchors(spark):
    rows = spark.range(200).select(F.col("id").alias("seq_id"), (F.col("id") % 37).cast("int").alias("len"))
    a = sorted(r.seq_id for r in sampling.sample_k(rows, 20).collect())
    assert a == sorted(r.seq_id for r in sampling.sample_k(rows.repartition(7), 20).collect()) and len(set(a)) == 20
    assert len(sampling.without(rows, sampling.sample_k(rows, 20)).collect()) == 180
    anchors = sampling.anchors_by_length(rows).orderBy("rank").collect()
    assert len(anchors) == 32 and [r.rank for r in anchors] == list(range(0, 192, 6)) and anchors[0].len == 36
    assert sampling.anchors_by_length(rows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        distances.pairs(spark.range(distances.MAX_SAMPLE + 1).select(F.col("id").alias("seq_id"), F.lit("A").alias("seq")))


def test_cuts_stop_at_the_nearest(spark):
    parents = [8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, None]
    edges = [(0, x, p, (x * 7 % 5 + 1) / 8 if p else 0.0) for x, p in enumerate(parents)]
    tree = trees.from_edges(spark.createDataFrame(edges, "tree_id long, node long, parent long, bl double"))
    found = {r.seq_id: r.cut_node for r in trees.leaf_clusters(tree, tree.filter("node_id IN (8, 12)")).collect()}
    assert found == {0: 8, 1: 8, 2: 12, 3: 12, 4: None, 5: None, 6: None, 7: None}
    assert trees.cut_branches(tree, 3, 1, 0.5).count() <= 2


def evolved(rng, groups, members, length=160):
    rows = []
    for g in range(groups):
        base = rng.choices("ACGT", k=length)
        for _ in range(members):
            rows.append((len(rows), "".join(rng.choice("ACGT") if rng.random() < 0.04 else c for c in base if rng.random() > 0.01), g))
    return rows


def test_clustering_finds_simulated_groups(spark):
    rows = evolved(random.Random(7), 4, 15)
    random.Random(8).shuffle(rows)
    table = spark.createDataFrame(rows, "seq_id long, seq string, taxon long")
    options = clustering.Options(clusters=4, sample=32, min_descendants=3)
    members, roots = clustering.run(table.select("seq_id", "seq"), options)
    got = members.collect()
    assert sorted(r.seq_id for r in got) == list(range(60))
    assert clusters.shared_information(members, table).first().nmi > 0.8
    assert {r.cluster_id for r in got} == {r.cluster_id for r in roots.collect()}
    again, _ = clustering.run(table.repartition(5).select("seq_id", "seq"), options)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_small_and_wrong_inputs(spark):
    three = spark.createDataFrame([(i, "ACGT") for i in range(3)], "seq_id long, seq string")
    members, roots = clustering.run(three, clustering.Options(clusters=2, sample=5))
    assert sorted((r.cluster_id, r.seq_id, r.via) for r in members.collect()) == [(i, i, "left") for i in range(3)] and roots.count() == 3
    assert clustering.run(three.limit(0), clustering.Options(clusters=2, sample=5))[0].collect() == []
    four = spark.createDataFrame([(i, "ACGT") for i in range(4)], "seq_id long, seq string")
    for bad in (clustering.Options(1, 3), clustering.Options(4, 3), clustering.Options(2, 9)):
        with pytest.raises(ValueError):
            clustering.run(four, bad)


def test_measures(spark):
    members = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "cluster_id long, seq_id long")
    assert clusters.evenness(members).first().cv == 0
    same = members.select("seq_id", F.col("cluster_id").alias("taxon"))
    assert math.isclose(clusters.shared_information(members, same).first().nmi, 1)
    apart = members.select("seq_id", (F.col("seq_id") % 2).alias("taxon"))
    assert abs(clusters.shared_information(members, apart).first().nmi) < 1e-12


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = evolved(random.Random(9), 3, 6, 80)
    table = spark.createDataFrame(rows, "seq_id long, seq string, taxon long")
    roots = spark.createDataFrame([(g, rows[g * 6][1]) for g in range(3)], "cluster_id long, root_seq string")
    table.select("seq_id", "seq").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, seq string").parquet(str(tmp_path / "in"))
    assigning.start_assigning(stream, roots, 0.5, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.seq_id, r.cluster_id, round(r.d, 9), r.is_assigned) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.seq_id, r.cluster_id, round(r.d, 9), r.is_assigned) for r in clusters.assign(table, roots, 0.5).collect())
    assert all(c == rows[i][2] for i, c, *_ in got)


def test_formats_and_merges(spark, tmp_path):
    (tmp_path / "a").write_text(">x\nAC-T\n>y\nACGT\n")
    (tmp_path / "b").write_text("CLUSTAL W\n\nx AC-T\n")
    (tmp_path / "c").write_text(" MSF: 4 Type: N Check: 1 ..\n//\n x ACGT\n")
    (tmp_path / "d").write_text("nothing\n")
    assert [files.detect_format(spark, str(tmp_path / k)) for k in "abcd"] == ["fasta", "clustal", "msf", "unknown"]
    one = files.read_fasta(spark, str(tmp_path / "a"))
    assert files.is_aligned(one) == "aligned" and files.is_aligned(one.filter("name = 'y'")) == "maybe"
    both = files.merged(one, one).orderBy("seq_id").collect()
    assert [(r.seq_id, r.name) for r in both] == [(0, "x"), (1, "y"), (2, "x"), (3, "y")]


def test_score_cap(spark):
    pairs = spark.createDataFrame([("ACGT", "ACGT"), ("AAAA", "TTTT")], "a string, b string")
    assert [r.alignment is None for r in aligned(pairs, max_score=8).collect()] == [False, True]


def test_command_line(spark, tmp_path):
    from cladeforge.__main__ import arguments, cluster_files

    rows = evolved(random.Random(11), 3, 8, 90)
    (tmp_path / "in.fa").write_text("".join(f">s{i}\n{s.lower()}\n" for i, s, _ in rows))
    (tmp_path / "tax.tsv").write_text("".join(f"s{i}\tD;g{g}\n" for i, _, g in rows))
    args = arguments(["-i", str(tmp_path / "in.fa"), "-r", "18", "-b", "3", "-p", "2", "-o", str(tmp_path / "out"), "-t", str(tmp_path / "tax.tsv"), "-f", "-q"])
    members = cluster_files(spark, args)
    assert members.count() == len(rows)
    assert files.read_fasta(spark, str(tmp_path / "out/fasta/*")).count() == len(rows)
    assert files.read_taxonomy(spark, str(tmp_path / "out/taxonomy/*")).count() == len(rows)
    assert files.read_fasta(spark, str(tmp_path / "out/roots")).count() == members.select("cluster_id").distinct().count()
    (tmp_path / "bad.fa").write_text(">q\nACXE\n")
    with pytest.raises(ValueError):
        cluster_files(spark, arguments(["-i", str(tmp_path / "bad.fa"), "-r", "2", "-b", "2", "-o", str(tmp_path / "out2")]))


def test_fasta_in_a_column(spark):
    texts = [">a b\nac\nGT\n>c\r\nnn\r\n>d", "stray\n>x\nA C\n", "no header", "", None, ">only"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", S.fasta_records(F.col("text")).alias("r")).orderBy("k").collect()
    got = [None if r.r is None else [tuple(x) for x in r.r] for r in rows]
    assert got == [[("a b", "ACGT"), ("c", "NN"), ("d", "")], [("x", "AC")], [], [], None, [("only", "")]]


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf({"spark.sql.warehouse.dir": "/warehouse/"}), Context()

    with pytest.raises(ValueError):
        files.shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert files.shared_folder(Session()) == "/warehouse/_scratch"
    assert files.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
