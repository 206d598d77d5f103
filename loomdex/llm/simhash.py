"""SimHash fingerprints and their components by multi-index hashing.

Two fingerprints that differ in two bits at most agree on one 32-bit half, or differ by one bit
in each. So each half is a table segment: fingerprints look up their own half in both tables
and, in the first, the half with one of its zero bits set (a ball of radius one, from one side
only). Matches are verified on the whole distance. Exact copies share a fingerprint and
enter once.

A segment value shared by more than ``bucket`` fingerprints is not paired off: its fingerprints
enumerate the ball in the *other* half and look up whole fingerprints, 264 probes at most on average,
whatever the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.components import connected_components
from loomdex.llm.skew import look_up
from loomdex.runtime import stash

STEP = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text; 0 without words."""
    words = text.lower().split() if text else []  # of bytes: A-Z, and blanks 9-13 and 32 only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    whole = b" ".join(words)
    if n == 1:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        parts = [whole[a:b] for a, b in zip(starts[i : i + STEP], stops[i : i + STEP])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(rows: DataFrame, text_col: str, keep_text: bool = True, shingle: int = 3) -> DataFrame:
    """``rows`` with fp, a signed long, of the whole texts; null and blank ones have 0. The text goes unless ``keep_text``."""
    at = rows.columns.index(text_col)
    left = [f for f in rows.schema if keep_text or f.name != text_col]
    names = [f.name for f in left] + ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(at).cast(pa.binary())
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in t), np.uint64, b.num_rows)
            own = [c for i, c in enumerate(b.columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(fp.view(np.int64))], names=names)

    return rows.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in left) + "fp long")


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, fp) of (doc_id, text)."""
    return with_fingerprints(documents.select(F.col("doc_id").alias("id"), "text"), "text", False, shingle)


def _flip(x: Column, bit: Column) -> Column:
    return x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))


def _single(lo: int) -> list[int]:
    return [_signed(1 << (lo + i)) for i in range(32)]


def _pairs(lo: int) -> list[int]:
    return [_signed(1 << (lo + i) | 1 << (lo + j)) for i in range(32) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, bucket: int = 512) -> DataFrame:
    """(u, v) for all pairs of distinct fingerprints in column ``fp`` that differ in 1 or 2 bits."""
    one = fps.select("fp").where("fp is not null").distinct()
    high = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    table = one.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("val")), F.struct(F.lit(1).alias("seg"), low.alias("val")))).alias("s")).select(
        "fp", "s.seg", "s.val"
    )
    table = stash(table, "segments")
    hot = stash(table.groupBy("seg", "val").count().where(F.col("count") > bucket).select("seg", "val"), "hot")
    free = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("shiftrightunsigned", F.col("val"), b).bitwiseAND(F.lit(1)) == 0)
    first = table.where("seg = 0")
    flips = first.select("fp", "seg", F.explode(F.transform(free, lambda b: _flip(F.col("val"), b))).alias("val"), F.lit(True).alias("flip"))
    probes = table.select("fp", "seg", "val", F.lit(False).alias("flip")).unionByName(flips)
    some_hot = not hot.isEmpty()
    cold_table = table.join(hot, ["seg", "val"], "left_anti") if some_hot else table
    other = cold_table.select("seg", "val", F.col("fp").alias("v"))
    d = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
    found = probes.join(other, ["seg", "val"]).where(d.between(1, 2) & (F.col("flip") | (F.col("fp") < F.col("v")))).select(F.col("fp").alias("u"), "v")
    if some_hot:
        into = probes.join(hot, ["seg", "val"])
        # own half hot: up to two bits of the other half; a flip into a hot half: one bit of the other
        # (segment 0 is the upper half, so its other half starts at bit 0)
        masks = [F.array(*[F.lit(m) for m in _single(lo) + _pairs(lo)]) for lo in (0, 32)]
        ball = F.when(F.col("seg") == 0, masks[0]).otherwise(masks[1])
        own = into.where(~F.col("flip")).select("fp", F.explode(F.filter(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m)), lambda x: x > F.col("fp"))).alias("v"))
        side = F.transform(F.array(*[F.lit(m) for m in _single(0)]), lambda m: F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(m).bitwiseOR(F.call_function("shiftleft", F.col("val"), F.lit(32))))
        across = into.where("flip").select("fp", F.explode(side).alias("v"))
        exact = own.unionByName(across).join(one.select(F.col("fp").alias("v")), "v").select(F.col("fp").alias("u"), "v")
        found = found.unionByName(exact)
    return found.distinct()


def simhash_components(documents: DataFrame, bucket: int = 512) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document.

    component_id is the smallest doc_id reachable over links of at most 2 bits, its own included;
    null only if all doc_ids of a component are null. Null, empty and blank texts have fingerprint 0 and
    link like any other. Repeated rows each return a row.
    """
    fps = stash(fingerprints(documents), "fp")
    reps = stash(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "reps")
    pairs = stash(links(reps, bucket), "links")
    roots = connected_components(pairs).select(F.col("node").alias("fp"), "root")
    small = roots.join(reps, "fp").groupBy("root").agg(F.min("least").alias("c"))
    linked = roots.join(small, "root").select("fp", "c")
    comp = reps.join(linked, "fp", "left").select("fp", F.coalesce("c", "least").alias("component_id"))
    return look_up(fps, comp, "fp", reps).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(documents: DataFrame, bucket: int = 512) -> DataFrame:
    """One row of each component with all its columns: that with the smallest doc_id, null ids last, then the first as stored.

    Documents are written once with their fingerprints and numbered; only numbers and fingerprints are shuffled to decide. The
    rows that go are told apart by a look-up of their numbers.
    """
    columns = documents.columns
    named = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    fps = stash(with_fingerprints(named, f"c{columns.index('text')}").withColumn("row", F.monotonically_increasing_id()), "fp")
    order = F.struct(F.col("id").isNull().alias("void"), "id", "row")
    least = fps.select("fp", F.col(f"c{columns.index('doc_id')}").alias("id"), "row")
    reps = stash(least.groupBy("fp").agg(F.min(order).alias("least")), "reps")
    pairs = stash(links(reps, bucket), "links")
    roots = connected_components(pairs).select(F.col("node").alias("fp"), "root")
    found = reps.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    kept = stash(found.select(F.col("least.row").alias("row")), "kept")
    gone = stash(fps.select("row").join(kept, "row", "left_anti"), "gone")
    small = gone.count() * 16 <= 32 << 20
    out = fps.join(F.broadcast(gone), "row", "left_anti") if small else fps.join(kept, "row", "left_semi")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
