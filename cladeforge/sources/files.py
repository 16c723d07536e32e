"""FASTA, taxonomy and alignment files as DataFrames, and back. Compressed files are read and written by Spark's codecs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where a local session has no such setting (tests, a laptop), one below the warehouse; on a cluster that may be each
    machine's own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read again: plans stay short, and a lost executor costs one step."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cladeforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``table`` and its number of rows, which its own write tells: no pass over it is needed."""
    seen = Observation(name)
    held = table(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return held, seen.get.get("n", 0)


def ranked(rows: DataFrame, order: list[str], name: str = "seq_id") -> DataFrame:
    """``rows`` with dense 0-based ranks in the order of the columns, without one task that holds all.

    Rows are dealt out by ranges; a rank is the place in its partition plus the sizes of the partitions before it. The dealt
    rows are written before they are counted: planned twice, once with fewer columns, they would be sampled and joined into
    partitions in another way, and the sizes would be those of other partitions.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    sorted_rows = table(sorted_rows.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)), "ranked")
    sizes = sorted_rows.groupBy("__p").count()
    before = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).alias("__b"))
    return sorted_rows.join(F.broadcast(before), "__p").withColumn(name, F.col("__i") + F.coalesce("__b", F.lit(0))).drop("__p", "__i", "__b")


def place_within(rows: DataFrame, group: str, order: str | list[str], name: str) -> DataFrame:
    """``rows`` with the place (from 0) of each in its group, without one task that holds a group: rank less the group's first rank."""
    placed = ranked(rows, [group, *([order] if isinstance(order, str) else order)], "__rank")
    first = placed.groupBy(group).agg(F.min("__rank").alias("__first"))
    return placed.join(first, group).withColumn(name, F.col("__rank") - F.col("__first")).drop("__rank", "__first")


def read_fasta(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """``seq_id, name, seq, len``: records in file order, wrapped lines joined, upper case; headers end at the line's end.

    Empty records have an empty sequence; text before the first header is no record; CR LF line ends are allowed. ``by``: the
    column whose folders ``write_fasta`` made; it is kept.
    """
    kept = [by] if by else []
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", *kept)
    record = F.regexp_replace("value", "^>", "")
    # a record that is first in its file and has no mark of its own is text before the first header
    place = F.struct("block", "at")
    firsts = raw.groupBy("file").agg(F.min(place).alias("first"), F.min(F.when(~F.col("value").startswith(">"), place)).alias("plain"))
    stray = firsts.filter("first = plain").select("file", F.col("first.at").alias("at"))
    raw = raw.join(stray, ["file", "at"], "left_anti")
    cut = raw.filter(F.trim(record) != "").select("file", "block", "at", F.regexp_replace(F.substring_index(record, "\n", 1), "\r$", "").alias("name"), F.when(F.instr(record, "\n") > 0, F.upper(F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"[\s]", ""))).otherwise("").alias("seq"), *kept)
    return ranked(cut, ["file", "block", "at"]).select("seq_id", "name", "seq", F.length("seq").alias("len"), *kept)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``at, value``: lines and their places, which follow the order of files by name (Spark reads the largest first)."""
    return spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), "value")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``name, lineage, ranks`` of a tab-separated file; of repeated names the first stays."""
    parts = F.split("value", "\t", 2)
    rows = _lines(spark, path).select("at", F.get(parts, 0).alias("name"), F.regexp_replace(F.get(parts, 1), "\r$", "").alias("lineage")).filter("lineage IS NOT NULL")
    return rows.groupBy("name").agg(F.min_by("lineage", "at").alias("lineage")).withColumn("ranks", F.split("lineage", ";"))


def write_fasta(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Records of ``name, seq``; with ``by`` a folder for each value of that column."""
    lines = rows.select(*([by] if by else []), F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))
    (lines.write.partitionBy(by) if by else lines.write).mode("overwrite").text(path)


def write_taxonomy(rows: DataFrame, path: str, by: str | None = None) -> None:
    lines = rows.select(*([by] if by else []), F.concat("name", F.lit("\t"), F.coalesce("lineage", F.lit("(null)"))).alias("value"))
    (lines.write.partitionBy(by) if by else lines.write).mode("overwrite").text(path)


def clstr_lines(members: DataFrame) -> DataFrame:
    """Report lines ``cluster_id, pos, line`` of ``members(cluster_id, seq_id, name, len)``: a head at -1, then its members."""
    rows = place_within(members, "cluster_id", "seq_id", "pos").withColumn("pos", F.col("pos").cast("int")).select("cluster_id", "pos", F.format_string("%d\t%dnt, >%s...", F.col("pos"), F.col("len"), F.col("name")).alias("line"))
    heads = members.select("cluster_id").distinct().select("cluster_id", F.lit(-1).alias("pos"), F.format_string(">Cluster %d", F.col("cluster_id")).alias("line"))
    return heads.union(rows)


def write_clstr(members: DataFrame, path: str) -> None:
    lines = clstr_lines(members)
    lines.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id", "pos").select("line").write.mode("overwrite").text(path)


def write_roots(roots: DataFrame, path: str) -> None:
    """Root sequences ``cluster_id, root_seq, random``: the name tells where a member stands in for a small cluster's root."""
    name = F.concat(F.when(F.col("random"), "random").otherwise(""), F.col("cluster_id"))
    write_fasta(roots.select(name.alias("name"), F.col("root_seq").alias("seq")), path)


def statistics(sequences: DataFrame) -> DataFrame:
    """One row: number of sequences, longest, shortest, longest name."""
    return sequences.agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("max_len"), F.min("len").alias("min_len"), F.max(F.length("name")).alias("max_name"))


def duplicate_names(sequences: DataFrame) -> DataFrame:
    """Names that occur more than once, and whether their sequences differ."""
    return sequences.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(S.gcg_checksum(F.col("seq"))).alias("checksums")).filter("n > 1")


def unique_names(sequences: DataFrame) -> DataFrame:
    """Repeated names get a suffix _1, _2 ... in order of ``seq_id``; the first stays as it is."""
    placed, k = place_within(sequences, "name", "seq_id", "__k"), F.col("__k")
    return placed.withColumn("name", F.when(k > 0, F.concat("name", F.lit("_"), k)).otherwise(F.col("name"))).select(sequences.columns)


def detect_format(spark: SparkSession, path: str) -> str:
    """``fasta``, ``clustal``, ``msf`` or ``unknown``, by marks in the first 100 lines."""
    head = spark.read.text(path).limit(100)
    seen = head.agg(*[F.count_if(F.col("value").rlike(r)).alias(k) for k, r in (("fasta", "^>"), ("clustal", "^CLUSTAL|multiple sequence alignment"), ("msf", r"^//|MSF:|!!NA_MULT|!!AA_MULT"))]).first()
    return next((k for k in ("msf", "clustal", "fasta") if seen[k]), "unknown")


def is_aligned(sequences: DataFrame) -> str:
    """``aligned`` (gaps and one length), ``maybe`` (one length, no gaps) or ``unaligned``, by the first 50 sequences."""
    row = sequences.orderBy("seq_id").limit(50).agg(F.max(F.length("seq")).alias("most"), F.min(F.length("seq")).alias("least"), F.count_if(F.contains("seq", F.lit("-"))).alias("gaps")).first()
    return "unaligned" if row.most != row.least else "aligned" if row.gaps else "maybe"


def merged(*tables: DataFrame) -> DataFrame:
    """Sequences of several inputs, one after the other, with new dense ranks."""
    out = tables[0].withColumn("__t", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("__t", F.lit(k)))
    return ranked(out.withColumnRenamed("seq_id", "__s"), ["__t", "__s"]).drop("__t", "__s")


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """``name, aligned`` of a Clustal file: blocks of ``name letters`` lines are joined in file order."""
    line = F.trim(F.regexp_replace("value", "\r$", ""))
    rows = _lines(spark, path).filter(~F.col("value").rlike(r"^(CLUSTAL|\s|$)"))
    cut = rows.select("at", F.regexp_extract(line, r"^(\S+)\s+([A-Za-z.-]+)", 1).alias("name"), F.regexp_extract(line, r"^(\S+)\s+([A-Za-z.-]+)", 2).alias("part")).filter("part <> ''")
    return _joined(cut)


def read_msf(spark: SparkSession, path: str) -> DataFrame:
    """``name, aligned`` of an MSF file: what stands after the ``//`` line, dots and tildes as gaps."""
    rows = _lines(spark, path)
    start = rows.filter(F.col("value").rlike("^//")).agg(F.min("at").alias("start"))
    cut = rows.join(F.broadcast(start), F.col("at") > F.col("start")).select("at", F.regexp_extract("value", r"^\s*(\S+)\s+(.*)$", 1).alias("name"), F.translate(F.regexp_replace(F.regexp_extract("value", r"^\s*(\S+)\s+(.*)$", 2), r"\s", ""), ".~", "--").alias("part"))
    return _joined(cut.filter((F.col("part") != "") & ~F.col("part").rlike("^[0-9]+$")))


def _joined(parts: DataFrame) -> DataFrame:
    listed = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"), F.min("at").alias("first"))
    return listed.select("name", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("aligned"))


def alignment_lines(msa: DataFrame, kind: str = "clustal", width: int = 60) -> DataFrame:
    """Lines of an alignment file (``clustal``, ``msf`` or ``fasta``) of ``msa(name, aligned)``: ``part, pos, line``, to be sorted."""
    if kind == "fasta":
        return msa.select(F.lit(0).alias("part"), F.col("name").alias("pos"), F.concat(F.lit(">"), "name", F.lit("\n"), "aligned").alias("line"))
    cut = msa.select("name", F.posexplode(F.regexp_extract_all("aligned", F.lit(f"(.{{1,{width}}})"), 1)).alias("part", "piece"))
    body = cut.select((F.col("part") + 1).alias("part"), F.col("name").alias("pos"), F.format_string("%-30s %s", "name", F.col("piece") if kind == "clustal" else F.replace("piece", F.lit("-"), F.lit("."))).alias("line"))
    spark = msa.sparkSession
    if kind == "clustal":
        return spark.createDataFrame([(0, "", "CLUSTAL multiple sequence alignment\n")], "part int, pos string, line string").union(body)
    heads = msa.select(F.lit(0).alias("part"), F.concat(F.lit("1"), "name").alias("pos"), F.format_string(" Name: %s  Len: %d  Check: %d  Weight: 1.00", F.col("name"), F.length("aligned"), S.gcg_checksum(F.col("aligned"))).alias("line"))
    total = msa.agg(F.format_string(" MSF: %d  Type: N  Check: %d  ..\n", F.max(F.length("aligned")), F.sum(S.gcg_checksum(F.col("aligned"))) % 10000).alias("line")).select(F.lit(0).alias("part"), F.lit("0").alias("pos"), "line")
    return total.union(heads).union(spark.createDataFrame([(0, "2", "//")], "part int, pos string, line string")).union(body)


def write_alignment(msa: DataFrame, path: str, kind: str = "clustal") -> None:
    """``alignment_lines`` in order, in files that follow each other by name."""
    lines = alignment_lines(msa, kind).repartitionByRange("part", "pos").sortWithinPartitions("part", "pos")
    lines.select("line").write.mode("overwrite").text(path)


def newick(tree: DataFrame) -> str:
    """Newick text of one tree ``node_id, parent, bl, label``: for looking at, since a tree of a sample is small."""
    children, labels, root = {}, {}, None
    for r in tree.select("node_id", "parent", "bl", "label").orderBy("node_id").collect():
        labels[r.node_id] = (r.label, r.bl)
        if r.parent is None:
            root = r.node_id
        else:
            children.setdefault(r.parent, []).append(r.node_id)
    done: dict[int, str] = {}
    stack = [root]
    while stack:
        node = stack[-1]
        todo = [c for c in children.get(node, []) if c not in done]
        if todo:
            stack += todo
            continue
        inner = f"({','.join(done.pop(c) for c in children[node])})" if node in children else str(labels[node][0])
        done[node] = inner + ("" if node == root else f":{labels[node][1]:g}")
        stack.pop()
    return done[root] + ";"


