"""Global ranks, phrase tiers and weighted reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.config import RetrievalConfig
from loomdex.runtime import stash

LISTS = "list_no int, weight double, rank long, chunk_id string"


#: Rows that one task may rank.
FEW = 200_000


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank", bound: int | None = None) -> DataFrame:
    """0-based place in a total order, for tables of any size: a range-partitioned sort, then offsets per partition.

    The sorted rows are written once. Only one count per partition is gathered. A table that is known to have ``bound`` rows at
    most, and that no more than FEW, is ranked by one task in the plan of its reader; the places are the same.
    """
    if bound is not None and bound <= FEW:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long") - 1)
    placed = stash(df.orderBy(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    counts = placed.groupBy("__p").agg(F.count("*").alias("c")).withColumn(
        "before", F.coalesce(F.sum("c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    # a row per shuffle partition
    return placed.join(F.broadcast(counts.drop("c")), "__p").withColumn(name, F.col("before") + F.col("__i")).drop("__p", "__i", "before")


def phrase_tiers(lists: list[DataFrame], bound: int | None = None) -> DataFrame:
    """(tier, rank, chunk_id) of phrase lists (rank, chunk_id): ALL holds chunks of every list, ANY those of one at least.

    ``bound`` is what all lists together may hold at most, if that is known. Order: best rank in any list, then the first list that has the chunk and its rank there.
    """
    if not lists:
        raise ValueError("no phrases")
    every = reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("p"), F.col("rank").cast("long"), "chunk_id") for i, d in enumerate(lists)])
    best = every.groupBy("chunk_id").agg(F.min("rank").alias("best"), F.min(F.struct("p", "rank")).alias("first"), F.count_distinct("p").alias("n"))
    if len(lists) == 1:  # a list of distinct chunks is its own tier
        best = lists[0].groupBy("chunk_id").agg(F.min("rank").cast("long").alias("best"))
        return global_rank(best, "best", bound=bound).select(F.explode(F.array(F.lit("ALL"), F.lit("ANY"))).alias("tier"), "rank", "chunk_id")
    any_ = global_rank(best, "best", "first", bound=bound).withColumn("tier", F.lit("ANY"))
    all_ = global_rank(best.where(F.col("n") == len(lists)), "best", "first", bound=bound).withColumn("tier", F.lit("ALL"))
    return all_.unionByName(any_).select("tier", "rank", "chunk_id")


def rank_list(df: DataFrame, list_no: int, weight: float) -> DataFrame:
    return df.select(F.lit(list_no).alias("list_no"), F.lit(float(weight)).alias("weight"), F.col("rank").cast("long").alias("rank"), "chunk_id")


def reciprocal_rank_fusion(lists: DataFrame, top_k: int, k: int = RetrievalConfig.rrf_k) -> DataFrame:
    """(rank, chunk_id, score, percentage_score, source) of (list_no, weight, rank, chunk_id).

    A chunk counts once per list, at its best rank; empty lists add neither score nor weight. Ties
    by the first list that has the chunk, and its rank there.
    """
    # dealt by chunk once: both aggregations, and the second reading for the weights, take it from there
    once = lists.repartition("chunk_id").groupBy("list_no", "weight", "chunk_id").agg(F.min("rank").alias("rank"))
    total = once.select("list_no", "weight").distinct().agg(F.sum("weight").alias("total"))  # a row per list
    fused = once.groupBy("chunk_id").agg(
        F.round(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("first")
    )
    top = fused.orderBy(F.desc("score"), "first").limit(top_k).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "first")) - 1)
    return top.join(F.broadcast(total)).select(
        "rank", "chunk_id", "score", (F.col("score") / (F.col("total") / F.lit(float(k))) * 100).alias("percentage_score"), F.lit("fusion").alias("source")
    )


def percentage_by_top(ranked: DataFrame, source: str) -> DataFrame:
    """Scores in percent of the first row's; 0 if that is 0. ``ranked`` is a top-k."""
    top = F.first("score").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return ranked.select(
        "rank", "chunk_id", "score", F.when(top == 0, F.lit(0.0)).otherwise(F.col("score") / top * 100).alias("percentage_score"), F.lit(source).alias("source")
    )
