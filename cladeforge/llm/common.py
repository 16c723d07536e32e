"""Tables in the shared folder, and helpers that all training-data operators use."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import shared_folder

#: Rows of an Arrow batch: whole texts are long, and a batch stands in memory several times over.
BATCH_ROWS, ROWS_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage (its first argument is the session) whose session has small Arrow batches, unless it sets their size.

    The setting stays, since the result is worked out only when the caller asks for its rows.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        if spark.conf.get(ROWS_KEY, None) is None:
            spark.conf.set(ROWS_KEY, str(BATCH_ROWS))
        return query(spark, *args)

    return run


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cladeforge/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, so that extra input columns can never clash."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
