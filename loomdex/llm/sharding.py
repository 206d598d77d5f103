"""Uniform sharding with exact sizes by a hypergeometric communication matrix.

Rows start in source cells, fixed functions of the row, so a task that is run again deals alike. How many rows each cell
sends to each shard is drawn from the multivariate hypergeometric law on the driver: a matrix of at most
4096 x shards integers, whatever the number of rows. Cells are permuted locally, cut by the matrix, exchanged, and
every shard is permuted again. Result: a uniform random permutation, cut into
shards whose row counts differ by one at most.

Rows that are equal in all columns are interchangeable. They are counted first and numbered in spans, and
a cell is a hash of the row and its span, so no key and no repeated row fills a cell.

The second permutation ranks rows by an independent 64-bit draw. Its leading part picks one of
``sub`` ranges of a shard, so no task has to hold a whole shard: rank = rows in lower ranges +
rank within the range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.llm.literals import literal_table
from loomdex.runtime import stash

MAX_CELLS = 4096
MAX_RANGES = 1024
ROWS_A_CELL = 50_000
#: Equal rows of one number.
SPAN = 1000


def communication_matrix(cells: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[cell, shard]: rows as ``cells`` says, columns exact to within one, uniformly drawn."""
    rng = np.random.default_rng(seed)
    total = int(cells.sum())
    left = np.full(shards, total // shards, dtype=np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(cells), shards), dtype=np.int64)
    for i, n in enumerate(cells):
        # the marginals method, one shard at a time
        need, rest = int(n), int(left.sum())
        for s in range(shards):
            rest -= int(left[s])
            if not need:
                break
            out[i, s] = got = hypergeometric(rng, int(left[s]), rest, need)
            need -= got
        left -= out[i]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw: how many of ``n`` out of ``good`` + ``bad`` are good. The same at every size.

    The law's ratios p(k + 1) / p(k) are exact up to one rounding. From the mode outwards their products give all
    probabilities that matter (40 standard deviations; what is beyond is below any double), and a uniform number picks from their sums.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    total = good + bad
    deviation = (n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)) ** 0.5
    reach = int(40 * deviation) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    fall = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    sums = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    at = int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))
    return mode - len(fall) + min(at, len(sums) - 1)


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to shards-1) and ``slot`` (long, gapless from 0 in each shard).

    Only DataFrame functions touch rows. Columns must be of types that can be grouped. Nulls are values like any
    other. An empty table gives an empty result. Row counts of shards differ by one at most.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = stash(df.groupBy(*columns).agg(F.count("*").alias("__n")), "counted")
    total = counted.agg(F.sum("__n")).first()[0] or 0
    n_cells = max(16, min(MAX_CELLS, -(-total // ROWS_A_CELL)))
    n_sub = max(1, min(MAX_RANGES, -(-total // (shards * ROWS_A_CELL))))
    spans = counted.withColumn("__from", F.explode(F.sequence(F.lit(0), F.col("__n") - 1, F.lit(SPAN))))
    spans = spans.withColumns({
        "__cell": F.pmod(F.xxhash64(F.lit(seed + 2), *columns, "__from"), F.lit(n_cells)).cast("int"),
        "__upto": F.least("__n", F.col("__from") + SPAN),
    })
    # at most MAX_CELLS counts reach the driver
    seen = {r[0]: r[1] for r in spans.groupBy("__cell").agg(F.sum(F.col("__upto") - F.col("__from"))).collect()}
    matrix = communication_matrix(np.array([seen.get(c, 0) for c in range(n_cells)]), shards, seed)
    bounds = literal_table(
        df.sparkSession, [(c, [int(x) for x in np.cumsum(matrix[c])]) for c in range(n_cells)], __cell="int", __ends="array<bigint>"
    )
    # spans are exchanged, their rows are told apart behind the exchange
    keyed = spans.repartition("__cell").withColumn("__i", F.explode(F.sequence("__from", F.col("__upto") - 1)))
    first = F.xxhash64(F.lit(seed), *columns, "__i")
    local = keyed.withColumn("__first", first).withColumn("__rn", F.row_number().over(W.partitionBy("__cell").orderBy("__first", *columns, "__i")))
    # at most MAX_CELLS rows of ``shards`` numbers: the bound that allows the broadcast
    dealt = local.join(F.broadcast(bounds), "__cell").withColumn("shard", F.size(F.filter("__ends", lambda x: x < F.col("__rn"))).cast("int"))
    dealt = dealt.withColumn("__second", F.xxhash64(F.lit(seed + 3), "__cell", "__rn"))
    # an arithmetic shift keeps the order of the draws, so ranges are ordered too
    dealt = dealt.withColumn("__range", F.floor((F.shiftright("__second", 32) + F.lit(2**31)) * F.lit(n_sub) / F.lit(2.0**32)).cast("int"))
    dealt = dealt.select(*columns, "shard", "__second", "__range", "__cell", "__rn")
    order = ("__second", "__cell", "__rn")
    if n_sub == 1:
        slot = F.row_number().over(W.partitionBy("shard").orderBy(*order)) - 1
        out = dealt.withColumn("slot", slot.cast("long"))
    else:
        dealt = stash(dealt, "dealt")  # read twice
        sizes = dealt.groupBy("shard", "__range").agg(F.count("*").alias("__c"))
        before = sizes.withColumn(
            "__before", F.coalesce(F.sum("__c").over(W.partitionBy("shard").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ).drop("__c")
        rank = F.row_number().over(W.partitionBy("shard", "__range").orderBy(*order))
        # at most shards x MAX_RANGES rows
        out = dealt.withColumn("__rank", rank).join(F.broadcast(before), ["shard", "__range"]).withColumn(
            "slot", (F.col("__before") + F.col("__rank") - 1).cast("long")
        )
    return out.select(*columns, "shard", "slot")


def shard_documents(documents: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """The ``rows`` law over documents: see ``shuffle_into_shards``.

    Columns: doc_id, size (UTF-8 bytes + 16; null text: 16), text_crc32 (null text: that of no
    bytes), law, shard, slot, grown_shard (null: this law has no growth). Equal texts are separate rows.
    """
    narrow = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shuffle_into_shards(narrow, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
