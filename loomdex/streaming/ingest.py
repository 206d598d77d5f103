"""Incremental ingest: new markdown files to videos and chunks, new vectors to a run, the run to the active one.

``take_up`` streams: the file source remembers in its checkpoint which files it has seen, and every micro-batch writes
directories named by its batch id, so a batch that is run again overwrites its own only. ``publish``, ``embed_pending`` and ``promote`` then
write new versions of the store's tables. A version never changes and counts only once it is complete, so
readers see the last complete one, and an update that was interrupted is run again from where it stopped.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex import schemas
from loomdex.config import ChunkerConfig, IngestConfig
from loomdex.operators import catalog
from loomdex.operators.chunker import chunks_of, with_borders
from loomdex.sources.posts import long_enough, parse_all, to_videos, with_ids
from loomdex.sources.remote import embed_column

LOG = logging.getLogger(__name__)
COUNTERS = ("files", "unreadable", "too_short", "videos", "chunks")
#: Tables of a store and their schemas.
TABLES = {"videos": schemas.VIDEOS, "chunks": schemas.CHUNKS, "embeddings": schemas.EMBEDDINGS, "runs": schemas.RUNS}


class Store:
    """Versioned tables below one folder of any file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def folders(self, path: str) -> list[str]:
        """Names of a folder's complete sub-folders."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = fs.listStatus(p) if fs.exists(p) else []
        return [s.getPath().getName() for s in found if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]

    def version(self, name: str) -> int:
        """The last complete version; -1 before the first."""
        return max((int(f[2:]) for f in self.folders(f"{self.root}/{name}") if f.startswith("v=")), default=-1)

    def read(self, name: str) -> DataFrame:
        """The table as of its last complete version, empty before the first."""
        v = self.version(name)
        reader = self.spark.read.schema(TABLES[name])
        return self.spark.createDataFrame([], TABLES[name]) if v < 0 else reader.parquet(f"{self.root}/{name}/v={v}")

    def write(self, name: str, table: DataFrame) -> None:
        """The next version, of the table's columns and types."""
        wanted = self.spark.createDataFrame([], TABLES[name]).schema
        typed = table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
        typed.write.mode("overwrite").parquet(f"{self.root}/{name}/v={self.version(name) + 1}")

    def batches(self, name: str, after: int = -1) -> DataFrame | None:
        """Rows of the micro-batches behind ``after``, with their ``batch``."""
        own = sorted(int(f[6:]) for f in self.folders(f"{self.root}/taken/{name}") if f.startswith("batch="))
        paths = [f"{self.root}/taken/{name}/batch={b}" for b in own if b > after]
        return self.spark.read.option("basePath", f"{self.root}/taken/{name}").parquet(*paths) if paths else None


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (file_name, content) of markdown files."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(folder)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


def take_up(
    spark: SparkSession, folder: str, store: str, embed: Callable, chunker: ChunkerConfig = ChunkerConfig(), c: IngestConfig = IngestConfig()
) -> StreamingQuery:
    """Parse and split all files not seen before, then stop. ``embed`` refines the borders of chunks."""
    taken = f"{store.rstrip('/')}/taken"

    def batch(files: DataFrame, batch_id: int) -> None:
        own = f"batch={batch_id}"
        posts = with_ids(parse_all(files, c.drop_section), c.blog_base, c.watch_base).cache()
        good = long_enough(posts.where("readable"), c.min_transcript)
        chunks_of(with_borders(good, chunker, embed), c.overlap_chars).write.mode("overwrite").parquet(f"{taken}/chunks/{own}")
        to_videos(good).write.mode("overwrite").parquet(f"{taken}/videos/{own}")
        made = files.sparkSession.read.parquet(f"{taken}/chunks/{own}").count()
        seen = posts.agg(F.count("*").alias("files"), F.count_if(~F.col("readable")).alias("unreadable"), F.count_if("readable").alias("fine")).first()
        kept = good.count()
        counts = (seen["files"], seen["unreadable"], seen["fine"] - kept, kept, made)
        LOG.info("batch %d: %s", batch_id, dict(zip(COUNTERS, counts)))
        files.sparkSession.createDataFrame([counts], ", ".join(f"{x} long" for x in COUNTERS)).write.mode("overwrite").parquet(f"{taken}/counters/{own}")
        posts.unpersist()

    stream = new_files(spark, folder).writeStream.foreachBatch(batch)
    return stream.option("checkpointLocation", f"{store.rstrip('/')}/checkpoint").trigger(availableNow=True).start()


def counters(spark: SparkSession, store: str) -> dict[str, int]:
    """Files seen, those without readable front matter, those with too short a transcript, videos and chunks made, over all batches."""
    rows = Store(spark, store).batches("counters")
    got = rows.agg(*[F.sum(x).alias(x) for x in COUNTERS]).first() if rows is not None else None
    return {x: got[x] if got else 0 for x in COUNTERS}


def publish(spark: SparkSession, store: str) -> None:
    """Take what batches made since the last time into the tables of videos and chunks.

    Chunks keep their ordinals; new ones get the next, without gaps, so that ordinals number the chunks of any number of videos.
    Of a video that was taken up again the newest batch counts, and chunks that it has no longer go.
    """
    s = Store(spark, store)
    videos, chunks = s.read("videos"), s.read("chunks")
    last = videos.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    more = s.batches("videos", last)
    if more is None:
        return
    newest = more.withColumn("__r", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("batch")))).where("__r = 1").drop("__r")
    fresh = s.batches("chunks", last).join(newest.select("video_id", "batch"), ["video_id", "batch"], "left_semi").drop("batch")
    gone = chunks.join(newest.select("video_id"), "video_id", "left_semi").join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    # chunks first: a video is published only with its chunks
    s.write("chunks", catalog.upsert_chunks(chunks.join(gone.select("chunk_id"), "chunk_id", "left_anti"), fresh))
    s.write("videos", catalog.upsert(videos, newest, "video_id"))


def embed_pending(
    spark: SparkSession, store: str, embed: Callable, run_id: str, model: str, dimension: int, limit: int | None = None, batch: int = 8, notes: str = ""
) -> int:
    """A new run: the vectors of the active one and those of the chunks it lacks; returns how many were embedded.

    With ``limit`` only the first so many chunks by ordinal are embedded. The run is registered when its vectors are complete, and is not
    active. A run_id that exists raises.
    """
    s = Store(spark, store)
    runs, chunks, vectors = s.read("runs"), s.read("chunks"), s.read("embeddings")
    if not catalog.run_by_id(runs, run_id).isEmpty():
        raise ValueError(f"run {run_id!r} exists")
    active = catalog.active_run(runs).first()
    base = active["run_id"] if active else ""
    if active and active["dimension"] != dimension:
        base = ""  # another space: everything is embedded anew
    todo = catalog.pending(chunks, vectors, base)
    todo = todo.limit(limit) if limit is not None else todo
    new = embed_column(todo.select("chunk_id", "embed_text"), embed, "embed_text", batch)
    whole = catalog.append_vectors(vectors, base, run_id, new)
    stale = whole.join(chunks.select("chunk_id"), "chunk_id", "left_semi")  # vectors of chunks that are gone stay behind
    s.write("embeddings", vectors.where(F.col("run_id") != run_id).unionByName(stale))
    own = s.read("embeddings").where(F.col("run_id") == run_id)
    bad = own.where(F.size("embedding") != dimension).count()
    if bad:
        raise ValueError(f"{bad} vectors of run {run_id!r} haven't {dimension} components")
    row = spark.createDataFrame([(run_id, model, dimension, f"{s.root}/embeddings", False, notes)], "run_id string, model_name string, dimension int, path string, is_active boolean, notes string")
    s.write("runs", runs.unionByName(row.withColumn("created_at", F.current_timestamp())))
    return own.join(vectors.where(F.col("run_id") == base).select("chunk_id"), "chunk_id", "left_anti").count()


def promote(spark: SparkSession, store: str, run_id: str) -> None:
    """Make a run the active one; an unknown run raises."""
    s = Store(spark, store)
    s.write("runs", catalog.promote(s.read("runs"), run_id))


def update(
    spark: SparkSession, folder: str, store: str, embed: Callable, run_id: str, model: str, dimension: int,
    chunker: ChunkerConfig = ChunkerConfig(), c: IngestConfig = IngestConfig(),
) -> dict[str, int]:
    """Everything in order: new files, tables, vectors, and the new run promoted; returns the counters and ``embedded``.

    Nothing new makes no run.
    """
    take_up(spark, folder, store, embed, chunker, c).awaitTermination()
    publish(spark, store)
    s = Store(spark, store)
    active = catalog.active_run(s.read("runs")).first()
    lacking = catalog.pending(s.read("chunks"), s.read("embeddings"), active["run_id"] if active else "")
    n = 0
    if not lacking.isEmpty():
        n = embed_pending(spark, store, embed, run_id, model, dimension, batch=c.embed_batch)
        promote(spark, store, run_id)
    return counters(spark, store) | {"embedded": n}


def published(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(videos, chunks, embeddings, runs) as last published."""
    s = Store(spark, store)
    return tuple(s.read(t) for t in ("videos", "chunks", "embeddings", "runs"))
