"""Samples without replacement, what is left of them, and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """Order of a seeded sample; the same in any SQL engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_k(rows: DataFrame, k: int, seed: int = 42, key: str = "seq_id") -> DataFrame:
    """``k`` rows, the same for the same seed, whatever the partitions; a top-k, so no full sort."""
    return rows.orderBy(draw(F.col(key), seed), key).limit(k)


def only(rows: DataFrame, sample: DataFrame, key: str = "seq_id") -> DataFrame:
    return rows.join(sample.select(key), key, "left_semi")


def without(rows: DataFrame, taken: DataFrame, key: str = "seq_id") -> DataFrame:
    return rows.join(taken.select(key), key, "left_anti")


def anchors_by_length(rows: DataFrame, most: int = 32, key: str = "seq_id", length: str = "len") -> DataFrame:
    """Up to ``most`` rows at even strides in order of falling length (then of the key), with their ``rank``."""
    n = rows.count()
    k = min(most, n)
    if not k:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    stride = n // k
    from ..sources.files import ranked

    return ranked(rows.withColumn("__len", -F.col(length)), ["__len", key], "rank").drop("__len").filter((F.col("rank") % stride == 0) & (F.col("rank") < stride * k))


def random_member(members: DataFrame, seed: int = 42, cluster: str = "cluster_id", key: str = "seq_id") -> DataFrame:
    """One member of each cluster, the first in the order of the sample."""
    rest = [c for c in members.columns if c != cluster]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(draw(F.col(key), seed), F.col(key)))  # summed before rows meet
    return members.groupBy(cluster).agg(first.alias("one")).select(*[F.col(cluster) if c == cluster else F.col("one").getField(c).alias(c) for c in members.columns])
