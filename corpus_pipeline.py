"""Training-corpus pipeline over ``documents``: quality, near-copies, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import kneser_ney, mixing, packing, simhash
from loomdex.runtime import reach, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the Kneser-Ney classifier accepts."""
    reach(spark)
    return kneser_ney.accepted_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the smallest doc_id (null ids last), once if it is repeated."""
    reach(spark)
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring domain totals to their targets."""
    reach(spark)
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    reach(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("mixing", mix), ("packing", pack)]
#: Kneser-Ney scores, components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Rows are judged one by one, whatever doc_ids they share, null ones included. Null, empty and blank texts are not of quality and
    go first. Of equal rows one stays. Long texts are kept whole and cut into pieces by packing only. Extra columns pass all
    stages but the last. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
