"""The corpus pipeline: quality rules, near-dedup, removal of repeated strings, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared folder
and reads it again as the next stage's documents, so a lost executor costs the stage it works on and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from cladeforge.llm.common import materialize, small_batches, table


@small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.passing(docs)


@small_batches
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies."""
    return minhash.keep_one_of_each(docs)


@small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that stand elsewhere too; those with nothing left go."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.filter(F.length(F.trim("text")) > 0).withColumn("n_chars", F.length("text").cast("long"))


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated as the temperature-mixed weights of their sources say."""
    return mixing.mix(docs)


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    both = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), bpe.tokenizer_path(), decoded="decoded")
    return both.select("doc_id", "lang", "source", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_each),
    ("suffix_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Divergence verdicts, sketches and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
