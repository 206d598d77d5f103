"""The hybrid engine: routes a query to its legs and fuses their lists in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.config import RetrievalConfig
from loomdex.functions.text import tokens_of
from loomdex.operators.catalog import active_run, run_vectors
from loomdex.operators.lexical import LexicalIndex
from loomdex.operators.ranking import global_rank, percentage_by_top, phrase_tiers, rank_list, reciprocal_rank_fusion
from loomdex.operators.vector import VectorIndex, native_query_embedder, pooled_query_embedder
from loomdex.plans.intent import Intent, analyze


class SearchEngine(Protocol):
    """Anything that returns (rank, ordinal, chunk_id, score)."""

    def search(self, query: str, k: int) -> DataFrame: ...


#: Rows of a result whose ids are put into the readers' filters.
LITERAL = 1000


def with_payload(ranked: DataFrame, chunks: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Chunk and video columns for a top-k. Ranked ids without a chunk go; missing videos leave empty titles.

    The top-k is worked out once. Its ids, and those of its videos, go into the filters of the tables' readers, so stored tables are
    read only where they can hold them; only a top-k of over LITERAL rows is joined instead.
    """
    top = ranked.limit(LITERAL + 1).collect()
    if len(top) > LITERAL:
        own = chunks.join(F.broadcast(ranked), "chunk_id")
    else:
        few = ranked.sparkSession.createDataFrame(top, ranked.schema)
        own = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in top])).join(F.broadcast(few), "chunk_id")
    if videos is None:
        return own.orderBy("rank")
    named = videos.select("video_id", "title", "blog_url", "url", "video_length_chars")
    if len(top) <= LITERAL:
        ids = [r[0] for r in own.select("video_id").distinct().collect()]  # as many as the top-k has rows, at most
        named = F.broadcast(named.where(F.col("video_id").isin(ids)))
    out = own.join(named, "video_id", "left")
    return out.withColumns({"title": F.coalesce("title", F.lit("")), "blog_url": F.coalesce("blog_url", F.lit(""))}).orderBy("rank")


@dataclass
class HybridEngine:
    chunks: DataFrame  # ordinal, chunk_id, video_id, text, start_char, end_char
    lexical: LexicalIndex
    vectors: SearchEngine | None = None
    videos: DataFrame | None = None
    config: RetrievalConfig = RetrievalConfig()
    stopwords: frozenset[str] = frozenset()

    def intent(self, query: str) -> Intent:
        return analyze(query, self.stopwords)

    def phrase_list(self, phrase: str) -> DataFrame:
        found = self.lexical.phrase(phrase, self.chunks)
        return global_rank(found, F.desc("score"), "ordinal", bound=self.lexical.phrase_bound(phrase)).select("rank", "chunk_id")

    def tiers(self, phrases: list[str]) -> DataFrame:
        """Phrase tiers of the index's chunks; the index bounds how many there can be. One phrase's list is both of its tiers."""
        if len(phrases) == 1:
            return self.phrase_list(phrases[0]).select(F.explode(F.array(F.lit("ALL"), F.lit("ANY"))).alias("tier"), "rank", "chunk_id")
        return phrase_tiers([self.phrase_list(p) for p in phrases], sum(map(self.lexical.phrase_bound, phrases)))

    def ranked(self, query: str, top_k: int | None = None) -> DataFrame:
        """(rank, chunk_id, score, percentage_score, source), before any text is read."""
        c = self.config
        top_k = c.final_k if top_k is None else top_k
        ask = self.intent(query)
        semantic = self.vectors.search(query, c.per_engine) if ask.use_semantic and self.vectors is not None else None
        if ask.exact_phrases:  # all words' frequencies at once
            stems = [tokens_of(p) for p in (query, *ask.exact_phrases)]
            self.lexical.frequencies([t for s in stems for t in (*s, "".join(s)) if t])
        lexical = self.lexical.search(query, c.per_engine)
        tiers = self.tiers(ask.exact_phrases) if ask.exact_phrases else None
        if semantic is None and (tiers is None or tiers.isEmpty()):
            return percentage_by_top(lexical.where(F.col("rank") < top_k), "bm25")
        lists = rank_list(lexical, 1, ask.weights["bm25"])
        if semantic is not None:
            lists = lists.unionByName(rank_list(semantic, 0, ask.weights["semantic"]))
        if tiers is not None:
            every = F.col("tier") == "ALL"
            lists = lists.unionByName(tiers.select(
                F.when(every, 2).otherwise(3).alias("list_no"), F.when(every, c.weight_all).otherwise(c.weight_any).alias("weight"), "rank", "chunk_id"
            ))
        return reciprocal_rank_fusion(lists, top_k, c.rrf_k)

    def search(self, query: str, top_k: int | None = None) -> DataFrame:
        return with_payload(self.ranked(query, top_k), self.chunks, self.videos)

    def check_query_terms(self, query: str) -> list[tuple[str, str | None]]:
        return [(r["term"], r["suggestion"]) for r in sorted(self.lexical.suggest(query).collect(), key=lambda r: r["pos"])]


#: Fixed value: runs of this dimension hold vectors that were pooled from a wider model.
POOLED = 512


def query_embedder(dimension: int, embed: Callable[[list[str]], Sequence[Sequence[float]]], pooled: int = POOLED) -> Callable[[str], Sequence[float]]:
    """How queries are embedded for a run, by its dimension alone, so that queries and vectors share one space."""
    return pooled_query_embedder(embed, pooled) if dimension == pooled else native_query_embedder(embed)


def build_engine(
    chunks: DataFrame, vectors: DataFrame | None, embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None, runs: DataFrame | None = None,
    videos: DataFrame | None = None, config: RetrievalConfig = RetrievalConfig(), lexical: LexicalIndex | None = None,
) -> HybridEngine:
    """The engine over the vectors of the active run; its dimension picks the way queries are embedded. No active run raises."""
    legs = None
    if vectors is not None and runs is not None:
        active = active_run(runs).collect()
        if not active:
            raise ValueError("no active embedding run")
        run = active[0]
        own = run_vectors(vectors, run["run_id"]).join(chunks.select("chunk_id", "ordinal"), "chunk_id")
        legs = VectorIndex.build(own, query_embedder(run["dimension"], embed))
    return HybridEngine(chunks, lexical or LexicalIndex.build(chunks, config), legs, videos, config)
