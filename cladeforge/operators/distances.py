"""Pairs of a sample, their distances, site patterns, k-mer similarity and distances to anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.alignment import aligned, ungapped_counts
from ..functions.seeds import MAX_PLACES, SEGMENT, SeedIndex, SeedTable
from ..sources.files import counted, ranked, table

#: A sample is meant to be small: all pairs of one beyond this are refused.
MAX_SAMPLE = 10_000
#: Letters of a sample that are sent to all tasks at most.
MAX_SAMPLE_LETTERS = 64 << 20
#: Cells of dynamic programs for a task, about.
TASK_CELLS = 5_000_000_000


def pairs(sample: DataFrame, key: str = "seq_id", seq: str = "seq", within: str | None = None) -> DataFrame:
    """All pairs i < j of a sample (of each group ``within``, which is kept), with both sequences ``a, b``, dealt out evenly.

    Only ids are shuffled; sequences join them where their pairs are, from all tasks' own copy while the sample's counted
    letters are few enough for one.
    """
    told = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length(seq), F.lit(0))).alias("letters")).first()
    if within is None and told.n > MAX_SAMPLE:
        raise ValueError(f"a sample of {told.n} has too many pairs; at most {MAX_SAMPLE} sequences are compared with each other")
    # a stated number of partitions is not coalesced: alignment is long for few bytes
    letters = told.letters or 0
    tasks = min(max(int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")), letters * letters // (2 * TASK_CELLS)), MAX_SAMPLE)
    kept = [within] if within else []
    ids = sample.select(F.col(key).alias("i"), *kept)
    other = sample.select(F.col(key).alias("j"), *kept)
    dealt = (ids.join(other, within) if within else ids.join(F.broadcast(other), F.col("i") < F.col("j"))).filter("i < j").repartition(tasks, "i", "j")
    held = sample.select(F.col(key).alias("__key"), F.col(seq).alias("__seq"))
    held = F.broadcast(held) if letters <= MAX_SAMPLE_LETTERS else held
    for name, of in (("a", "i"), ("b", "j")):
        dealt = dealt.join(held.select(F.col("__key").alias(of), F.col("__seq").alias(name)), of)
    return dealt.select(*kept, "i", "j", "a", "b")


def pair_distances(of: DataFrame, aligner: str = "affine", keep: Sequence[str] = ()) -> DataFrame:
    """``i, j, score, cigar, d``: the distance over aligned sites; ``ungapped`` lays sequences side by side instead."""
    if aligner == "ungapped":
        rows = of.withColumn("alignment", ungapped_counts("a", "b")).select(*keep, "i", "j", F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("cigar"), "alignment.different", "alignment.sites")
    else:
        rows = aligned(of, aligner).select(*keep, "i", "j", "alignment.*")
    return rows.withColumn("d", S.jukes_cantor(F.col("different"), F.col("sites")))


def binary_patterns(of: DataFrame) -> DataFrame:
    """``i, j, a, b, n``: distinct columns of side-by-side pairs with how often each occurs, counted where the pair is."""
    kinds = [f"{c} {of.schema[c].dataType.simpleString()}" for c in "ij"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells, counts = [], [], []
            for k, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                n = min(len(a or ""), len(b or ""))
                u, v = (np.frombuffer((s or "")[:n].encode("ascii", "replace"), np.uint8).astype(np.int64) for s in (a, b))
                cell, count = np.unique(u << 8 | v, return_counts=True)
                at.append(np.full(len(cell), k))
                cells.append(cell)
                counts.append(count)
            at, cells = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*cells, np.zeros(0, np.int64)])
            letters = [pa.array([chr(c) for c in x.tolist()], pa.string()) for x in (cells >> 8, cells & 255)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in (0, 1)), *letters, pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64))], names=["i", "j", "a", "b", "n"])

    return of.select("i", "j", "a", "b").mapInArrow(run, ", ".join([*kinds, "a string, b string, n long"]))


def matrix(distances: DataFrame, ids: DataFrame, width: int = 64, key: str = "seq_id") -> DataFrame:
    """``i, block, c0 ... c{width - 1}``: the full matrix of ``distances(i, j, d)`` by blocks of ``width`` columns.

    Column k of block b is the id of rank ``b * width + k`` among ``ids`` (in order of the key); 0 on the diagonal, null where
    a pair has no row or there is no such id. A row of the result has ``width`` values, however many ids there are.
    """
    placed = table(ranked(ids.select(key), [key], "place"), "matrix-columns")
    half = distances.select("i", "j", "d")
    both = half.union(half.select("j", "i", "d")).union(ids.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("d")))
    named = both.join(placed.withColumnRenamed(key, "j"), "j").select("i", F.floor(F.col("place") / width).cast("int").alias("block"), (F.col("place") % width).alias("k"), "d")
    return named.groupBy("i", "block").agg(*[F.max(F.when(F.col("k") == k, F.col("d"))).alias(f"c{k}") for k in range(width)])


def number_of_pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


#: Members, or clusters, whose ids and numbers are sent to all tasks at most.
MAX_MEMBERS = 1_000_000


def mean_between(distances: DataFrame, members: DataFrame, leave_out: int | None = None) -> DataFrame:
    """One row ``mean``: the mean over pairs of clusters of the mean distance between their members.

    ``leave_out``: a cluster (the residual one) that takes no part. Members are written once; up to MAX_MEMBERS of them, counted
    as they are written, go to all tasks, and more are joined by id.
    """
    of = members.select("seq_id", "cluster_id")
    of, n = counted(of if leave_out is None else of.filter(F.col("cluster_id") != leave_out), "members")
    few = F.broadcast if n <= MAX_MEMBERS else lambda x: x
    named = distances.select("i", "j", "d").join(few(of.toDF("i", "ci")), "i").join(few(of.toDF("j", "cj")), "j").filter("ci <> cj")
    each = named.groupBy(F.least("ci", "cj").alias("ci"), F.greatest("ci", "cj").alias("cj")).agg(F.avg("d").alias("d"))
    return each.agg(F.avg("d").alias("mean"))


#: Matches that a diagonal must have more of; rows of an index that is sent to all tasks; rows of a code that meet in a task.
LEAST_MATCHES, MAX_INDEX, CODE_ROWS = 61.08, 2_000_000, 100_000


def seed_index(sequences: DataFrame, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``code, key, place``: an inverted index of the spaced seeds, a row a seed and place."""
    return sequences.select(key, F.explode(S.seed_codes(F.col(seq))).alias("s")).select("s.code", key, "s.place")


def _looked_up(left: DataFrame, names: np.ndarray, held: SeedTable | SeedIndex, least: float) -> DataFrame:
    """``i, j, similarity`` of ``left(i, seq)`` against what all tasks hold of the sequences ``names``."""
    from .clusters import dealt

    few = left.sparkSession.sparkContext.broadcast((names, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = few.value
        for batch in batches:
            seqs = [s or "" for s in batch.column(1).to_pylist()]
            once = {s: held.matches(s, least) for s in set(seqs)}
            told = [once[s] for s in seqs]
            at, j = np.nonzero(np.stack(told)) if told else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(names[j], pa.int64()), pa.array([int(told[x][y]) for x, y in zip(at, j, strict=True)], pa.int64())], names=["i", "j", "similarity"])

    own = left.select(F.col("i").cast("long").alias("seq_id"), "seq")
    return dealt(own, own.select("seq_id")).select("seq_id", "seq").mapInArrow(run, "i long, j long, similarity long")


def seed_similarity(left: DataFrame, right: DataFrame, least: float = LEAST_MATCHES, most: int | None = None) -> DataFrame:
    """``i, j, similarity`` of ``left(i, seq)`` and ``right(j, seq)``: matches on the diagonals that have more than ``least`` of them.

    While ``right`` has MAX_PLACES counted places or fewer, all tasks have its sequences as a ``SeedTable`` and hold each
    sequence of ``left`` against it where it is; equal ones of a batch once.

    Of more, or where ``most`` is given, seeds meet by code, in an index: no two sequences are paired that share none, and only
    pairs with such a diagonal come out. While the counted index of ``right`` has ``most`` (MAX_INDEX) rows or fewer, all tasks
    have it and look each sequence of ``left`` up where it is; nothing else is shuffled than ids (``dealt``). A larger index is joined by code; codes are few
    and all frequent, so the rows of each are split by a salt that follows their number, and diagonals are counted by partial
    sums before they meet.
    """
    if most is None:
        right = table(right.select("j", "seq"), "seed-right")
        places = right.agg(F.sum(F.greatest(F.length(F.coalesce("seq", F.lit(""))) - 5, F.lit(0)).cast("long") + SEGMENT).alias("n")).first().n or 0
        if places <= MAX_PLACES:
            held = right.orderBy("j").toArrow()
            return _looked_up(left, held.column("j").to_numpy(), SeedTable([s or "" for s in held.column("seq").to_pylist()]), least)
    index, rows = counted(seed_index(right, "j"), "seed-index")
    if rows <= (MAX_INDEX if most is None else most):
        held = index.toArrow()
        names, owner = np.unique(held.column("j").to_numpy(), return_inverse=True)
        return _looked_up(left, names, SeedIndex(held.column("code").to_numpy(), owner, held.column("place").to_numpy()), least)
    own = table(seed_index(left.select("i", "seq"), "i"), "seed-index")
    salts = own.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / CODE_ROWS).cast("int").alias("salts"))  # a row a code
    salted = own.join(F.broadcast(salts), "code").withColumn("salt", F.pmod(F.xxhash64("i", "place"), F.col("salts")).cast("int"))
    copies = index.withColumnRenamed("place", "q").join(F.broadcast(salts), "code").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = salted.join(copies.select("code", "salt", "j", "q"), ["code", "salt"])
    diagonals = met.groupBy("i", "j", (F.col("q") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    return diagonals.groupBy("i", "j").agg(F.sum("n").alias("similarity"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


#: Bytes of anchors that are sent to all tasks at once.
MAX_ANCHOR_BYTES = 32 << 20


def _anchor_blocks(anchors: DataFrame, vector: str, key: str) -> list[DataFrame]:
    """``anchor_id, __anchor``: all anchors, in as many blocks by hash as their counted size asks for."""
    all_ = anchors.select(F.col(key).alias("anchor_id"), F.col(vector).alias("__anchor"))
    size = all_.agg(F.sum(F.coalesce(F.size("__anchor"), F.lit(0)).cast("long") * 8 + 16).alias("n")).first().n or 0
    n = -(-size // MAX_ANCHOR_BYTES)
    return [all_] if n <= 1 else [all_.filter(F.pmod(F.xxhash64("anchor_id"), F.lit(n)) == k) for k in range(n)]


def to_anchors(vectors: DataFrame, anchors: DataFrame, vector: str = "embedding", key: str = "vec_id", keep: Sequence[str] = ()) -> DataFrame:
    """Distance of every vector to each anchor, with columns ``keep``. Anchors are broadcast, in blocks where their counted size is beyond MAX_ANCHOR_BYTES."""
    parts = [vectors.join(F.broadcast(block)).select(key, "anchor_id", *keep, euclidean(F.col(vector), F.col("__anchor")).alias("d")) for block in _anchor_blocks(anchors, vector, key)]
    return reduce(DataFrame.unionByName, parts)
