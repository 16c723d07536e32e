"""FASTA as a source format, table functions, and the stream with a pool."""

import io
import random

import pytest
from pyspark.sql import functions as F

from cladeforge.functions import table_functions
from cladeforge.functions.alignment import aligned
from cladeforge.functions.seeds import coded, seed_table
from cladeforge.plans import clustering
from cladeforge.sources import fasta, files
from cladeforge.streaming import assigning

TEXTS = {
    "plain.fa": ">a one\nACGT\n>b\nAC\nGT\n>c\n\n>d\nTTTT",
    "crlf.fa": ">a\r\nac gt\r\nNN\r\n>b\r\n\r\n>\r\nAC\r\n",
    "stray.fa": "; a note\nACGT\n>x>y\nAA>CC\n>\n>z\nGG\n",
    "none.fa": "no header\nat all\n",
    "blank.fa": "",
    "head.fa": ">only",
}


def expected(text):
    """Records by lines, and the byte place of each header."""
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        if line.startswith(">"):
            out.append([at, line[1:].removesuffix("\n").removesuffix("\r"), "", line])
        elif out:
            out[-1][2] += "".join(line.split()).upper()
            out[-1][3] += line
        at += len(line.encode())
    return [(a, n, s) for a, n, s, raw in out if raw[1:].strip(" \n")]


@pytest.mark.parametrize("name", TEXTS)
def test_every_range_gives_the_records_that_begin_in_it(name):
    raw = TEXTS[name].encode()
    whole = [(at, *fasta.parsed(r)) for at, r in fasta.records(io.BytesIO(raw), 0, len(raw)) if fasta.parsed(r)]
    assert whole == [(a, n, s) for a, n, s in expected(TEXTS[name])]
    for size in (1, 2, 3, 5, 7, 100):
        for read in (1, 4, 1000):
            parts = [x for b in range(0, len(raw), size) for x in fasta.records(io.BytesIO(raw), b, min(b + size, len(raw)), read)]
            assert [(at, *fasta.parsed(r)) for at, r in parts if fasta.parsed(r)] == whole, (size, read)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "long.fa").write_text("".join(f">long {k}\n" + "".join(rng.choices("ACGTn", k=rng.randint(0, 300))) + "\n" for k in range(200)))
    (tmp_path / "_hidden").write_text(">no\nA\n")
    return tmp_path


@pytest.mark.parametrize("size", [64 << 20, 777])
def test_source_equals_the_reader(spark, folder, size):
    as_rows = lambda df: [(r.name, r.seq, r.len) for r in df.orderBy("seq_id").collect()]
    got = fasta.fasta_table(spark, str(folder), size)
    n = sum(len(expected((folder / name).read_bytes().decode())) for name in [*TEXTS, "long.fa"])
    assert sorted(r.seq_id for r in got.collect()) == list(range(n))
    assert as_rows(got) == as_rows(files.read_fasta(spark, str(folder)))
    raw = spark.read.format("fasta").option("rangeBytes", size).load(str(folder))
    assert as_rows(raw) == as_rows(got) and raw.select("seq_id").distinct().count() == n
    assert raw.rdd.getNumPartitions() >= (1 if size > 777 else 20)
    for name in ("crlf.fa", "blank.fa"):
        assert as_rows(fasta.fasta_table(spark, f"{folder}/{name}", size)) == [(n, s, len(s)) for _, n, s in expected(TEXTS[name])]
    assert as_rows(fasta.fasta_table(spark, f"file://{folder}/plain.fa")) == as_rows(fasta.fasta_table(spark, f"{folder}/plain.fa"))


def test_stream_of_files_takes_each_once(spark, tmp_path):
    fasta.register(spark)
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()

    def go():
        stream = spark.readStream.format("fasta").load(str(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.name, r.seq) for r in spark.read.parquet(out).collect())

    (source / "1.fa").write_text(">a\nAC\n>b\nGT\n")
    assert go() == [("a", "AC"), ("b", "GT")]
    (source / "2.fa").write_text(">c\nTT\n")
    assert go() == [("a", "AC"), ("b", "GT"), ("c", "TT")]
    assert go() == [("a", "AC"), ("b", "GT"), ("c", "TT")]
    assert spark.read.parquet(out).select("seq_id").distinct().count() == 3


# --- table functions --------------------------------------------------------------------------------------------------


def test_table_functions_in_sql(spark):
    table_functions.register(spark)
    rows = [(1, "ACGTACGTAC", "ACGACGTTAC"), (2, "AAAA", "CCCCCC"), (3, "", "AC"), (4, None, "A")]
    pairs = aligned(spark.createDataFrame(rows, "i long, a string, b string"))
    pairs.select("i", "a", "b", "alignment.cigar").createOrReplaceTempView("pairs")
    ops = spark.sql("SELECT i, o.* FROM pairs, LATERAL cigar_ops(cigar) o").collect()
    for i, a, b in rows:
        mine = sorted((r for r in ops if r.i == i), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        if a is None:
            assert not mine
            continue
        assert sum(r.n for r in mine if r.op != "I") == len(a) and sum(r.n for r in mine if r.op != "D") == len(b)
        for r in mine:
            if r.op in "MX":
                assert all((x == y) == (r.op == "M") for x, y in zip(a[r.a_start : r.a_start + r.n], b[r.b_start : r.b_start + r.n], strict=True))
    seeds = spark.sql("SELECT i, s.code, s.place FROM pairs, LATERAL spaced_seeds(a) s").collect()
    codes, places = seed_table(coded(rows[0][1]))
    assert sorted((r.code, r.place) for r in seeds if r.i == 1) == sorted(zip(codes.tolist(), places.tolist(), strict=True))
    assert {r.i for r in seeds} == {1}
    texts = spark.createDataFrame(list(enumerate(TEXTS.values())) + [(99, None)], "k long, text string")
    texts.createOrReplaceTempView("texts")
    records = spark.sql("SELECT k, r.* FROM texts, LATERAL fasta_records(text) r").collect()
    for k, text in enumerate(TEXTS.values()):
        assert [(r.name, r.seq) for r in sorted((r for r in records if r.k == k), key=lambda r: r.place)] == [(n, s) for _, n, s in expected(text)]


# --- stream with a pool -----------------------------------------------------------------------------------------------


def test_a_batch_run_again_writes_nothing_twice(spark, tmp_path):
    rng = random.Random(2)
    roots = [(k, "".join(rng.choices("ACGT", k=120))) for k in range(3)]
    far = [(100 + k, "".join(rng.choices("ACGT", k=120))) for k in range(12)]
    near = [(k, roots[k % 3][1][: 100 + k]) for k in range(9)]
    root_table = spark.createDataFrame(roots, "cluster_id long, root_seq string")
    write = assigning.batch_writer(root_table, 0.3, str(tmp_path))
    one = spark.createDataFrame(near[:5] + far[:6], "seq_id long, seq string")
    two = spark.createDataFrame(near[5:] + far[6:], "seq_id long, seq string")
    assert assigning.pool_rows(spark, str(tmp_path)).count() == assigning.assigned_rows(spark, str(tmp_path)).count() == 0
    for batch, number in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, number)
    assert sorted((r.seq_id, r.cluster_id) for r in assigning.assigned_rows(spark, str(tmp_path)).collect()) == [(k, k % 3) for k, _ in near]
    assert sorted((r.seq_id, r.seq) for r in assigning.pool_rows(spark, str(tmp_path)).collect()) == far
    members, more = assigning.cluster_pool(spark, str(tmp_path), root_table, clustering.Options(clusters=2, sample=8, min_descendants=2))
    assert sorted(r.seq_id for r in members.collect()) == [i for i, _ in far]
    told = {r.cluster_id for r in more.collect()}
    assert set(range(3)) < told and {r.cluster_id for r in members.collect()} <= told - set(range(3))
    small, all_roots = assigning.cluster_pool(spark, str(tmp_path), root_table, clustering.Options(clusters=50, sample=60))
    assert {r.cluster_id for r in small.collect()} == set(range(3, 15)) and all_roots.count() == 15


def test_a_stream_leaves_its_pool(spark, sf_dir, tmp_path):
    from cladeforge import queries

    rows = queries.QUERIES["stream_pool"](spark, sf_dir).collect()
    expected_ids = {r.seq_id for r in queries.QUERIES["saved_for_later"](spark, sf_dir).collect()}
    assert {r.seq_id for r in rows} == expected_ids and len(rows) == len(expected_ids)


def test_written_out_fasta_comes_back(spark, sf_dir):
    from cladeforge import queries

    got = {r.name: (r.len, r.checksum) for r in queries.QUERIES["fasta_source"](spark, sf_dir).collect()}
    rows = queries.sequences(spark, sf_dir)
    assert got == {r.name: (r.len, r.c) for r in rows.select("name", "len", queries.S.gcg_checksum(F.col("seq")).alias("c")).collect()}
