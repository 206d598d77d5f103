"""Tables of videos, chunks and embedding runs: look-ups, upserts and checks.

A change yields a new table; callers write it to a new version directory, never over the one being read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.operators.ranking import global_rank


def literal_ids(df: DataFrame, ids: Sequence[str], name: str) -> DataFrame:
    """(pos, name) of a driver-side list."""
    return df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {name} string")


def fetch_in_order(chunks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Chunks in the order of ``ids``; unknown ids go, repeated ones repeat."""
    return chunks.join(F.broadcast(literal_ids(chunks, ids, "chunk_id")), "chunk_id").orderBy("pos")


def videos_of(videos: DataFrame, ids: Sequence[str]) -> DataFrame:
    return videos.where(F.col("video_id").isin(list(dict.fromkeys(ids))))


def video_of_post(videos: DataFrame, blog_url: str) -> DataFrame:
    """The video of a blog post."""
    return videos.where(F.col("blog_url") == blog_url)


def chunk_by_id(chunks: DataFrame, chunk_id: str, base: str = "ordinal") -> DataFrame:
    """One chunk. Where the id's leading number is the column ``base``, the scan can skip row groups by it."""
    number = re.match(r"(0|[1-9]\d{0,17})_", chunk_id)
    near = chunks.where(F.col(base) == int(number[1])) if number else chunks.where("false")
    return near.where(F.col("chunk_id") == chunk_id)


def chunks_of_vectors(chunks: DataFrame, embeddings: DataFrame, run_id: str) -> DataFrame:
    return embeddings.where(F.col("run_id") == run_id).select("chunk_id").join(chunks, "chunk_id")


def run_vectors(embeddings: DataFrame, run_id: str) -> DataFrame:
    """(chunk_id, embedding) of a run."""
    return embeddings.where(F.col("run_id") == run_id).select("chunk_id", "embedding")


def pending(chunks: DataFrame, embeddings: DataFrame, run_id: str) -> DataFrame:
    """Chunks without a vector in the run."""
    done = embeddings.where(F.col("run_id") == run_id).select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti").orderBy("ordinal")


def new_posts(posts: DataFrame, videos: DataFrame) -> DataFrame:
    """Posts whose blog_url is unknown."""
    return posts.join(videos.select("blog_url"), "blog_url", "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """All columns of the newest row per key; of repeated incoming keys the last by ``order``."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("__new"), *([F.desc(order)] if order else [])))
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__r", rank).where("__r = 1").drop("__r", "__new")


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known chunks get all else from ``incoming`` and keep ordinal, video and index; unknown ones go behind the last ordinal, by chunk_id."""
    renew = [c for c in existing.columns if c not in ("ordinal", "chunk_id", "video_id", "chunk_idx")]
    fresh = incoming.select("chunk_id", *[F.col(c).alias(f"__{c}") for c in (*renew, "video_id", "chunk_idx")], F.lit(True).alias("__in"))
    known = existing.join(fresh, "chunk_id", "left")
    last = existing.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last")).first()["last"]
    added = global_rank(fresh.join(existing.select("chunk_id"), "chunk_id", "left_anti"), "chunk_id", name="__place")
    return known.select(
        "ordinal", "chunk_id", "video_id", "chunk_idx", *[F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in renew]
    ).unionByName(added.select(
        (F.col("__place") + F.lit(last + 1)).alias("ordinal"), "chunk_id", F.col("__video_id").alias("video_id"), F.col("__chunk_idx").alias("chunk_idx"),
        *[F.col(f"__{c}").alias(c) for c in renew],
    ))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"))


def promote(runs: DataFrame, run_id: str) -> DataFrame:
    """The run alone is active; an unknown run raises."""
    if runs.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"no run {run_id!r}")
    return runs.withColumn("is_active", F.col("run_id") == run_id)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def active_run(runs: DataFrame) -> DataFrame:
    return runs.where("is_active").limit(1)


def latest_run(runs: DataFrame, dimension: int, but: str = "") -> DataFrame:
    """The newest run of a dimension, other than ``but``."""
    return runs.where((F.col("dimension") == dimension) & (F.col("run_id") != but)).orderBy(F.desc("created_at"), "run_id").limit(1)


def append_vectors(embeddings: DataFrame, base_run: str, new_run: str, new: DataFrame) -> DataFrame:
    """Vectors of a new run: those of the base run and the new ones (chunk_id, embedding)."""
    base = embeddings.where(F.col("run_id") == base_run).select("chunk_id", "embedding")
    return base.unionByName(new.select("chunk_id", "embedding")).select(F.lit(new_run).alias("run_id"), "chunk_id", "embedding")


def max_end_char(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("video_id").agg(F.max("end_char").alias("max_end_char"))


def next_row(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(column) + 1, F.lit(0)).alias("next_row"))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of lowest ``order`` per key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def orphans(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """Chunks whose video is missing; must be empty."""
    return chunks.join(videos.select("video_id"), "video_id", "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
