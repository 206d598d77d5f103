"""Exact vector search by inner product of unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions.vectors import dot_with, norm, normalize


def unit(v: Sequence[float]) -> list[float]:
    x = np.asarray(v, np.float64)
    n = np.linalg.norm(x)
    return (x / n if n else x).tolist()


def clean_query(query: str) -> str:
    return query.replace('"', " ").strip()


def expand_query(query: str) -> str:
    """Queries of two words at most are put as a topic."""
    return f"Discussion about {query}" if len(query.split()) <= 2 else query


def pooled_query_embedder(embed: Callable[[list[str]], Sequence[Sequence[float]]], width: int) -> Callable[[str], list[float]]:
    """The query embedding of runs whose vectors were pooled to ``width``: put as a topic, embedded, pooled to means of neighbours, of unit length."""

    def one(query: str) -> list[float]:
        v = np.asarray(embed([expand_query(clean_query(query))])[0], np.float64)
        if len(v) % width:
            raise ValueError(f"{len(v)} components can't be pooled to {width}")
        return unit(v.reshape(width, -1).mean(axis=1))

    return one


def native_query_embedder(embed: Callable[[list[str]], Sequence[Sequence[float]]]) -> Callable[[str], list[float]]:
    return lambda query: list(embed([query])[0])


def expanded(query: Column) -> Column:
    """``expand_query`` of a column."""
    few = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) <= 2
    return F.when(few, F.concat(F.lit("Discussion about "), query)).otherwise(query)


def validity(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """One row: rows, wrong_dimension, with_nan, zero_norm."""
    v = F.col(column)
    return vectors.agg(
        F.count("*").alias("n_rows"),
        F.count_if(v.isNull() | (F.size(v) != dimension)).alias("wrong_dimension"),
        F.count_if(F.exists(v, lambda x: F.isnan(x))).alias("with_nan"),
        F.count_if(norm(v) == 0).alias("zero_norm"),
    )


def require_valid(vectors: DataFrame, dimension: int) -> None:
    r = validity(vectors, dimension).first()
    if r["wrong_dimension"] or r["with_nan"] or r["zero_norm"]:
        raise ValueError(f"bad vectors: {r.asDict()}")


@dataclass
class VectorIndex:
    """vectors(ordinal, chunk_id, embedding), normalised once."""

    vectors: DataFrame
    embed: Callable[[str], Sequence[float]] | None = None

    @classmethod
    def build(cls, vectors: DataFrame, embed=None, cache: bool = True) -> VectorIndex:
        table = vectors.select("ordinal", "chunk_id", normalize(F.col("embedding")).alias("embedding"))
        return cls(table.cache() if cache else table, embed)

    def save(self, path: str) -> None:
        """A new directory only: an index version never changes. Sorted by ordinal, so look-ups skip row groups."""
        self.vectors.sort("ordinal").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embed=None) -> VectorIndex:
        return cls(spark.read.parquet(path), embed)

    def search_vector(self, q: Sequence[float], k: int) -> DataFrame:
        """(rank, ordinal, chunk_id, score): the best k by inner product (six decimals), then ordinal."""
        score = F.round(dot_with(F.col("embedding"), unit(q)), 6)
        top = self.vectors.select("ordinal", "chunk_id", score.alias("score")).orderBy(F.desc("score"), "ordinal").limit(k)
        return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ordinal")) - 1).select("rank", "ordinal", "chunk_id", "score")

    def search(self, query: str, k: int) -> DataFrame:
        q = clean_query(query)
        if not q:
            return self.vectors.where("false").select(F.lit(0).alias("rank"), "ordinal", "chunk_id", F.lit(0.0).alias("score"))
        if self.embed is None:
            raise ValueError("no embedder given")
        return self.search_vector(self.embed(q), k)
