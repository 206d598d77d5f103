"""Splitting transcripts at coherent places.

Sentences and speaker turns are segments. A border between two segments is a candidate if the words around it
overlap or a blank line lies there; its confidence weighs word overlap, similarity of embeddings and
the blank line. Candidates compete within a few hundred characters, then borders are taken in order.
The last two steps depend on earlier decisions, so a document is one row of an Arrow batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.config import ChunkerConfig
from loomdex.functions.text import tokens_of

#: Fixed value: what a segment is.
SEGMENT = re.compile(r"\S.*?(?:[.!?]+(?:\s|\n|$)|(?:\n\n+|$))", re.DOTALL)
#: With the white space before each segment, matches tile the text.
TILES = r"(?sU)\s*\S.*?(?:[.!?]+(?:\s|\z)|(?:\n\n+|\z))"
Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def segment_ends(text: Column) -> Column:
    """Array of segment end offsets, by Spark alone."""
    parts = F.regexp_extract_all(text, F.lit(TILES), F.lit(0))
    return F.aggregate(
        parts, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p)))
    )


def overlap(left: list[str], right: list[str]) -> float:
    """Size of the multiset intersection over the longer side's size."""
    if not left or not right:
        return 0.0
    return sum((Counter(left) & Counter(right)).values()) / max(len(left), len(right))


def overlap_of(left: Column, right: Column) -> Column:
    """``overlap`` of two columns of word arrays."""
    most, least = F.greatest(F.size(left), F.size(right)), F.least(F.size(left), F.size(right))

    def times(words: Column, w: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == w))

    common = F.aggregate(F.array_intersect(left, right), F.lit(0), lambda s, w: s + F.least(times(left, w), times(right, w)))
    return F.when(least > 0, common / most).otherwise(F.lit(0.0))


def window_overlaps(words: list[list[str]], window: int) -> list[float]:
    """``overlap`` of the ``window`` segments before and after each inner border; every word enters and leaves each side once."""
    sides = Counter(), Counter(w for ws in words[:window] for w in ws)
    sizes, common, out = [0, sides[1].total()], 0, []

    def put(side: int, ws: list[str], by: int) -> None:
        nonlocal common
        own, other = sides[side], sides[1 - side]
        for w in ws:
            # the smaller count decides: it moves if this side's does and is not above the other's
            common += (own[w] < other[w]) if by > 0 else -(own[w] <= other[w])
            own[w] += by
        sizes[side] += by * len(ws)

    for i in range(1, len(words)):
        put(1, words[i - 1], -1)
        put(0, words[i - 1], 1)
        if i - 1 + window < len(words):
            put(1, words[i - 1 + window], 1)
        if i - 1 - window >= 0:
            put(0, words[i - 1 - window], -1)
        out.append(common / max(sizes) if min(sizes) else 0.0)
    return out


def confidence(lexical: float, similarity: float | None, gap: float, c: ChunkerConfig) -> float:
    x = c.lexical_weight * (1 - lexical) + c.embedding_weight * (1 - (similarity or 0.0)) + c.gap_weight * gap
    return float(min(1.0, max(0.0, x)))


def survivors(places: list[int], conf: list[float], window: int) -> list[int]:
    """Indices left after candidates within ``window`` characters have competed, in order of place."""
    out = [True] * len(places)
    for i, at in enumerate(places):
        j = i + 1
        while out[i] and j < len(places) and places[j] - at <= window:
            loser = i if conf[j] > conf[i] else j
            out[loser] = False
            j += 1
    return [i for i, alive in enumerate(out) if alive]


def borders(text: str, c: ChunkerConfig = ChunkerConfig(), embed: Embed | None = None, stopwords: frozenset[str] = frozenset()) -> list[int]:
    """Border offsets of one transcript."""
    if c.refine and embed is None:
        raise ValueError("refinement needs an embedder")
    spans = [(m.start(), m.end(), m.group().strip()) for m in SEGMENT.finditer(text)]
    words = [[w for w in re.findall(r"\b\w+\b", s.lower()) if w not in stopwords] for _, _, s in spans]
    found = []
    for i, o in enumerate(window_overlaps(words, c.window), 1):
        gap = float("\n" * c.gap_lines in text[spans[i - 1][1] : spans[i][0]])
        if o > c.overlap_threshold or gap:
            found.append((i, o, gap))
    sims: dict[int, float] = {}
    if c.refine and found:
        sides = []
        for i, _, _ in found:
            sides.append(" ".join(s for _, _, s in spans[max(0, i - c.embedding_window) : i]))
            sides.append(" ".join(s for _, _, s in spans[i : i + c.embedding_window]))
        vecs = [np.asarray(v, float) for a in range(0, len(sides), c.embedding_batch) for v in embed(sides[a : a + c.embedding_batch])]
        for n, (i, _, _) in enumerate(found):
            a, b = vecs[2 * n], vecs[2 * n + 1]
            sims[i] = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    conf = [confidence(o, sims.get(i), gap, c) for i, o, gap in found]
    kept = survivors([spans[i - 1][1] for i, _, _ in found], conf, c.competition)
    sure = {found[n][0]: conf[n] for n in kept}
    out, last = [], 0
    for i in range(1, len(spans)):
        size, cut = spans[i][1] - last, spans[i - 1][1]
        hard = sure.get(i, 0.0) >= c.hard_confidence and size >= c.min_chars
        if (hard or size >= c.max_chars) and not 0 < len(text) - cut < c.min_chars:
            out.append(cut)
            last = cut
    return out


def with_borders(posts: DataFrame, c: ChunkerConfig = ChunkerConfig(), embed: Embed | None = None, column: str = "transcript") -> DataFrame:
    """``posts`` with an array column ``borders``; null text has none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([borders(t or "", c, embed) for t in texts])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return posts.withColumn("borders", F.pandas_udf(run, "array<int>")(F.col(column)))


def slices(text: Column, cut: Column, extra: int = 0) -> Column:
    """Array of (idx, start_char, end_char, text): ``text`` cut at the offsets, each piece ``extra`` characters longer on both sides."""
    n = F.size(cut)
    size = F.length(text)

    def piece(i: Column) -> Column:
        a = F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1))
        b = F.when(i == n, size).otherwise(F.get(cut, i))
        start, stop = F.greatest(a - extra, F.lit(0)), F.least(b + extra, size)
        return F.struct(i.alias("idx"), a.alias("start_char"), b.alias("end_char"), F.substring(text, start + 1, stop - start).alias("text"))

    return F.transform(F.sequence(F.lit(0), n), piece)


def chunks_of(posts: DataFrame, extra: int = 200) -> DataFrame:
    """chunk_id, video_id, chunk_idx, text, embed_text, summary, start_char, end_char of posts (video_id, transcript, borders)."""
    summary = F.nullif(F.col("summary_markdown"), F.lit("")) if "summary_markdown" in posts.columns else F.lit(None).cast("string")
    both = posts.select(
        "video_id", summary.alias("summary"), F.explode(F.arrays_zip(slices(F.col("transcript"), F.col("borders")).alias("s"), slices(F.col("transcript"), F.col("borders"), extra).alias("e"))).alias("z")
    )
    return both.select(
        F.concat_ws("_", "video_id", F.col("z.s.idx").cast("string")).alias("chunk_id"), "video_id", F.col("z.s.idx").alias("chunk_idx"),
        F.col("z.s.text").alias("text"), F.col("z.e.text").alias("embed_text"), "summary", F.col("z.s.start_char").alias("start_char"), F.col("z.s.end_char").alias("end_char"),
    )


def bag_embedder(width: int = 64) -> Embed:
    """Deterministic stand-in for a hosted model: hashed bag of stems; ones for empty texts."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in tokens_of(t):
                v[zlib.crc32(w.encode()) % width] += 1.0
            out.append(v if any(v) else [1.0] * width)
        return out

    return embed
