"""Packing documents into token sequences by linear grouping.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` counts. There

1. large lengths, sorted, form ``groups`` groups of equal cardinality, each rounded up to its largest;
2. the covering programme over those few sizes is solved by column generation (patterns from
   a knapsack), and rounded down; patterns leave some room, for small lengths to fill;
3. actual lengths take the places of the rounded ones;
4. what is left, and the small lengths, goes in by best fit, in decreasing order.

A plan is a list of runs of equal sequences, so it stays small. Documents find their places by
their rank among the pieces of their length, which two-level counts give without gathering a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.llm.tokens import encoder
from loomdex.runtime import stash

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: (sequences alike, ((length, times in each), ...))
Run = tuple[int, tuple[tuple[int, int], ...]]


class OpenRuns:
    """Runs of equal sequences by what is still free in them."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.runs, self.full = capacity, [], {}, []

    def put(self, count: int, content: tuple, left: int) -> None:
        if left == 0:
            self.full.append((count, content))
            return
        if left not in self.runs:
            insort(self.free, left)
            self.runs[left] = []
        self.runs[left].append((count, content))

    def take(self, length: int) -> tuple[int, tuple, int] | None:
        """A run with the least free place that holds ``length``."""
        i = bisect_left(self.free, length)
        if i == len(self.free):
            return None
        left = self.free[i]
        count, content = self.runs[left].pop()
        if not self.runs[left]:
            del self.runs[left], self.free[i]
        return count, content, left

    def best_fit(self, length: int, count: int) -> None:
        """Place ``count`` pieces, each in the fullest sequence that holds it."""
        while count:
            got = self.take(length)
            have, content, left = got or (count, (), self.capacity)
            each = left // length
            full = min(have, count // each)
            if full == 0:
                full, each = 1, count
            self.put(full, (*content, (length, each)), left - each * length)
            count -= full * each
            if got and have > full:
                self.put(have - full, content, left)

    def all(self) -> list[Run]:
        return self.full + [r for left in self.free for r in self.runs[left]]


def patterns_for(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Fractional cover of ``counts`` by patterns: revised simplex, entering columns by knapsack."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        y = np.linalg.solve(basis.T, np.ones(k))
        value, pick = [np.zeros(capacity + 1)], []
        for _ in range(capacity // int(sizes.min())):
            best, who = value[-1].copy(), np.full(capacity + 1, -1)
            for g in range(k):
                s = int(sizes[g])
                cand = value[-1][: capacity + 1 - s] + y[g]
                better = cand > best[s:] + 1e-12
                best[s:][better] = cand[better]
                who[s:][better] = g
            value.append(best)
            pick.append(who)
        if value[-1][capacity] <= 1 + 1e-6:
            break
        column, w = np.zeros(k), capacity
        for who in reversed(pick):
            if who[w] >= 0:
                column[who[w]] += 1
                w -= int(sizes[who[w]])
        x, d = np.linalg.solve(basis, counts.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, counts.astype(float))
    return [(basis[:, i], max(0.0, float(x[i]))) for i in range(k)]


def group_plan(hist: dict[int, int], capacity: int, groups: int, small: int, reserve: int = 0) -> list[Run]:
    """Linear grouping over a histogram of lengths; configurations leave ``reserve`` free for small lengths."""
    open_ = OpenRuns(capacity)
    room = capacity - reserve
    large = sorted(((n, c) for n, c in hist.items() if small < n <= room and n < capacity), reverse=True)
    for n, c in hist.items():
        if n > room or n == capacity:  # nothing large fits beside these
            open_.put(c, ((n, 1),), capacity - n)
    rest: dict[int, int] = {n: c for n, c in hist.items() if n <= small}
    total = sum(c for _, c in large)
    if total:
        k = min(groups, total)
        upto = [total * (i + 1) // k for i in range(k)]
        stacks: list[list[list[int]]] = [[] for _ in range(k)]  # of each group: [length, count], longest first
        seen = g = 0
        for n, c in large:
            while c:
                put = min(c, upto[g] - seen)
                if put:
                    stacks[g].append([n, put])
                seen += put
                c -= put
                g += seen == upto[g]
        sizes = np.array([s[0][0] for s in stacks])
        distinct, at = np.unique(sizes, return_inverse=True)
        counts = np.bincount(at, weights=[sum(c for _, c in s) for s in stacks]).astype(np.int64)
        merged: list[list[list[int]]] = [[] for _ in distinct]
        for i, s in zip(at, stacks):
            merged[i] += s
        for column, x in patterns_for(distinct, counts, room):
            times, left = int(x + 1e-9), [sum(c for _, c in s) for s in merged]
            uses = [(g, int(m)) for g, m in enumerate(column) if m]
            times = min([times, *(left[g] // m for g, m in uses)])
            if not times:
                continue
            # the pieces of a place are runs of equal lengths; where any place changes, a new run begins
            places = [_cut(merged[g], times) for g, m in uses for _ in range(m)]
            while places[0]:
                step = min(p[0][1] for p in places)
                lengths = sorted((p[0][0] for p in places), reverse=True)
                open_.put(step, tuple((n, lengths.count(n)) for n in dict.fromkeys(lengths)), capacity - sum(lengths))
                for p in places:
                    p[0][1] -= step
                    if not p[0][1]:
                        p.pop(0)
        for s in merged:
            for n, c in s:
                rest[n] = rest.get(n, 0) + c
    for n in sorted(rest, reverse=True):
        open_.best_fit(n, rest[n])
    return open_.all()


def _cut(stack: list[list[int]], n: int) -> list[list[int]]:
    """Take ``n`` pieces off the front."""
    out = []
    while n:
        got = min(n, stack[0][1])
        out.append([stack[0][0], got])
        stack[0][1] -= got
        n -= got
        if not stack[0][1]:
            stack.pop(0)
    return out


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = 8, small: int | None = None) -> list[Run]:
    """The linear grouping that needs the fewest sequences, of those with ``groups`` up to sixteen times as many sizes, and several rooms.

    It stops at the lower bound. Few sizes are best where small lengths fill what rounding leaves; more sizes where there are few small ones.
    Without room, configurations of large lengths leave gaps that no small length fits. ``small`` is a third of the capacity, a quarter for many sizes.
    """
    bound = -(-sum(n * c for n, c in hist.items()) // capacity)
    best, least = [], None
    tries = [(k * groups, 3, room) for k in (1, 2, 4) for room in (0.1, 0.15, 0.03, 0.0, 0.2)] + [(16 * groups, 4, 0.0)]
    for k, part, room in tries:
        runs = group_plan(hist, capacity, k, capacity // part if small is None else small, int(room * capacity))
        size = sum(c for c, _ in runs)
        if least is None or size < least:
            best, least = runs, size
        if least <= bound:
            break
    return best


def places(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, times in each, offset) for every run and length."""
    out, next_rank, base = [], {}, 0
    for count, content in runs:
        offset = 0
        for n, each in content:
            a = next_rank.get(n, 0)
            out.append((n, a, a + count * each, base, each, offset))
            next_rank[n] = a + count * each
            offset += n * each
        base += count
    return out


def pieces_of(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of whole documents, each ended by id 0, cut only beyond ``capacity``."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = own.ids(text.as_py()) + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, groups: int = 8) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece holding id 0. Repeated rows and null doc_ids are packed
    like any other. An empty table gives an empty result. Extra columns are ignored.
    """
    spark = documents.sparkSession
    cut = pieces_of(documents, capacity, vocabulary).withColumn("row", F.monotonically_increasing_id())
    cut = stash(cut, "pieces")  # numbered once; later reads see the same numbers
    hist = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    total = sum(hist.values())
    table = places(plan(hist, capacity, groups))
    # runs are bounded by lengths and patterns, not by documents; a plan of many runs is joined by length instead
    where = spark.createDataFrame(table or [(0, 0, 0, 0, 1, 0)], "n long, a long, b long, base long, each long, at long")
    cells = max(16, min(4096, -(-total // 50_000)))
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    counts = cut.groupBy("length", "cell").agg(F.count("*").alias("c"))
    before = counts.select(
        "length", "cell",
        F.coalesce(F.sum("c").over(W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    ranked = cut.withColumn("rn", F.row_number().over(W.partitionBy("length", "cell").orderBy("row")))
    ranked = ranked.join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    hit = (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))
    j = F.col("rank") - F.col("a")
    return ranked.join(F.broadcast(where) if len(table) <= 100_000 else where, hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(j / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(j, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
