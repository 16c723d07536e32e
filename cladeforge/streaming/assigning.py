"""Assignment of a stream of sequences to known roots, and the pool of those that are near none.

``start_assigning`` keeps no state and needs no watermark. ``start_pooling`` writes each micro-batch under its own number, so a
batch that is run again after a failure replaces what it wrote before, and nothing is there twice; ``cluster_pool`` is a batch
job that clusters the pool and gives the roots to go on with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clusters import assign
from ..plans import clustering

ASSIGNED = "seq_id long, cluster_id long, d double, batch long"
POOL = "seq_id long, seq string, d double, batch long"


def start_assigning(sequences: DataFrame, roots: DataFrame, threshold: float, out: str, checkpoint: str, aligner: str = "affine") -> StreamingQuery:
    """Append assignments of a streaming ``sequences(seq_id, seq)`` to a Parquet folder, from where the last run stopped.

    Rows with ``is_assigned`` false are the pool of a later clustering run. ``roots`` fit one block (``clusters.root_blocks``);
    for more, ``start_pooling``. What is aligned is dealt out evenly first: alignment is long for few bytes, and one file
    would be one task.
    """
    if aligner != "ungapped":
        sequences = sequences.repartition(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = assign(sequences, roots, threshold, aligner)
    return told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(roots: DataFrame, threshold: float, out: str, aligner: str = "affine") -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: its assigned rows go to ``out/assigned/batch=n``, the others with their sequences to ``out/pool/batch=n``.

    Both are overwritten, so the same batch may come any number of times. Ids are unique within the stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = clustering.table(batch.select(F.col("seq_id").cast("long").alias("seq_id"), "seq"), "stream-batch")
        told = clustering.table(assign(rows, roots, threshold, aligner), "stream-told")
        told.filter("is_assigned").select("seq_id", "cluster_id", "d").write.mode("overwrite").parquet(f"{out}/assigned/batch={number}")
        left = told.filter("NOT is_assigned").select("seq_id", "d")
        rows.join(left, "seq_id").select("seq_id", "seq", "d").write.mode("overwrite").parquet(f"{out}/pool/batch={number}")

    return write


def start_pooling(sequences: DataFrame, roots: DataFrame, threshold: float, out: str, checkpoint: str, aligner: str = "affine") -> StreamingQuery:
    """Assign a streaming ``sequences(seq_id, seq)``, each micro-batch once however often it is tried; roots of any size."""
    writer = sequences.writeStream.foreachBatch(batch_writer(roots, threshold, out, aligner))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # no batch has come yet


def assigned_rows(spark: SparkSession, out: str) -> DataFrame:
    """``seq_id, cluster_id, d, batch`` of all that the stream has assigned."""
    return _written(spark, f"{out}/assigned", ASSIGNED)


def pool_rows(spark: SparkSession, out: str) -> DataFrame:
    """``seq_id, seq, d, batch`` of all that is near no root."""
    return _written(spark, f"{out}/pool", POOL)


def cluster_pool(spark: SparkSession, out: str, roots: DataFrame, options: clustering.Options) -> tuple[DataFrame, DataFrame]:
    """Members of the pool's own clusters, and all roots: those given, and the pool's, numbered after them.

    A pool smaller than the sample is its own sample; one too small for the clusters asked for gives each sequence its own.
    """
    held, n = clustering.counted(pool_rows(spark, out).select("seq_id", "seq"), "stream-pool")
    first = (roots.agg(F.max("cluster_id").alias("top")).first().top or 0) + 1 if not roots.isEmpty() else 0
    if n <= max(options.clusters, 3):
        found = held.select(F.lit(1).alias("round"), (F.row_number().over(clustering._by_id()) - 1).cast("long").alias("cluster_id"), "seq_id", F.lit("left").alias("via"))  # a few rows
        new = held.join(found, "seq_id").select("cluster_id", F.col("seq").alias("root_seq"))
    else:
        found, new = clustering.run(held, replace(options, sample=min(options.sample, n)))
    found = clustering.table(found.withColumn("cluster_id", F.col("cluster_id") + first), "pool-members")
    new = new.select((F.col("cluster_id") + first).alias("cluster_id"), "root_seq")
    return found, clustering.table(roots.select("cluster_id", "root_seq").union(new), "pool-roots")
