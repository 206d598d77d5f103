"""Command line: update a store from markdown files, or do its steps one by one; build indexes; search and answer."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from loomdex.operators.catalog import run_vectors
from loomdex.operators.chunker import bag_embedder
from loomdex.operators.lexical import LexicalIndex
from loomdex.operators.vector import VectorIndex
from loomdex.plans.engine import HybridEngine, build_engine, query_embedder
from loomdex.plans.rag import RagPipeline, render
from loomdex.streaming import ingest

#: Width of the embedder that stands in for a hosted model.
WIDTH = 64


def excerpts_only(system: str, user: str, **options) -> str:
    """Stands in for a hosted language model: it repeats the first excerpt."""
    return "[1] " + user.split("Transcript excerpt:\n", 1)[-1].split("\n---", 1)[0][:400]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomdex", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *more: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for m in ("store", *more):
            c.add_argument(m)
        return c

    command("update", "take up new files, embed what is new, promote the run", "folder", "run")
    command("ingest", "take up and publish new files", "folder")
    e = command("embed", "make a run of the chunks that the active run lacks", "run")
    e.add_argument("--limit", type=int)
    e.add_argument("--model", default="bag")
    command("promote", "make a run the active one", "run")
    command("index", "build and save the lexical index and the active run's vectors", "path")
    command("counters", "what the ingest has seen")
    for name, text in (("search", "hybrid search"), ("answer", "an answer from the excerpts found, with its sources")):
        q = command(name, text, "query")
        q.add_argument("--index", help="saved indexes")
        q.add_argument("-k", type=int, default=3)
    return p


def engine_of(spark: SparkSession, store: str, index: str | None, embed: Callable) -> HybridEngine:
    videos, chunks, vectors, runs = ingest.published(spark, store)
    if not index:
        return build_engine(chunks, vectors, embed, runs, videos)
    legs = VectorIndex.load(spark, f"{index}/vectors", query_embedder(WIDTH, embed))
    return HybridEngine(chunks, LexicalIndex.load(spark, f"{index}/lexical"), legs, videos)


def main(args: list[str] | None = None, embed: Callable | None = None, generate: Callable[..., str] = excerpts_only) -> int:
    o = parser().parse_args(args)
    spark = SparkSession.builder.appName("loomdex").getOrCreate()
    embed = embed or bag_embedder(WIDTH)
    if o.command == "update":
        print(json.dumps(ingest.update(spark, o.folder, o.store, embed, o.run, "bag", WIDTH)))
    elif o.command == "ingest":
        ingest.take_up(spark, o.folder, o.store, embed).awaitTermination()
        ingest.publish(spark, o.store)
    elif o.command == "embed":
        print(ingest.embed_pending(spark, o.store, embed, o.run, o.model, WIDTH, o.limit))
    elif o.command == "promote":
        ingest.promote(spark, o.store, o.run)
    elif o.command == "counters":
        print(json.dumps(ingest.counters(spark, o.store)))
    elif o.command == "index":
        _, chunks, vectors, runs = ingest.published(spark, o.store)
        LexicalIndex.build(chunks, cache=False).save(f"{o.path}/lexical")
        run = runs.where("is_active").first()
        if run is None:
            raise SystemExit("no active run")
        own = run_vectors(vectors, run["run_id"]).join(chunks.select("chunk_id", "ordinal"), "chunk_id")
        VectorIndex.build(own, cache=False).save(f"{o.path}/vectors")
    else:
        engine = engine_of(spark, o.store, o.index, embed)
        if o.command == "search":
            render(engine.search(o.query, o.k), o.query).show(truncate=100)
        else:
            got = RagPipeline(engine, generate, o.k).answer(o.query)
            print(got.answer)
            for c in got.citations:
                print(f"[{c['number']}] {c['title']} {c['timestamp']} {c['url'] or c['blog_url']} ({c['percentage_score']:.1f}%)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
