"""Look-ups by keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / SHARE of all rows is hot. Fewer than SHARE keys can be, whatever the table's size.
SHARE = 1024


def look_up(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each value of ``key``, null not among them.

    Rows of hot keys meet their row of the table by a broadcast of fewer than SHARE rows and stay where they are; all other
    rows are shuffled. ``counts`` is (key, n) of ``rows``, counted here if it is not given. ``rows`` is read
    twice, so it should be a stored table. ``how`` is inner or left.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts.select(key, "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where((F.col("n") * SHARE > F.lit(total)) & F.col(key).isNotNull()).select(key).collect()] if total else []
    if total <= SHARE or not hot:
        return rows.join(table, key, how)
    few = rows.sparkSession.createDataFrame([(k,) for k in hot], counts.select(key).schema)
    mine = F.broadcast(few)
    own = rows.join(F.broadcast(table.join(mine, key, "left_semi")), key, how) if how == "inner" else rows.join(mine, key, "left_semi").join(
        F.broadcast(table.join(mine, key, "left_semi")), key, how
    )
    return own.unionByName(rows.join(mine, key, "left_anti").join(table, key, how))
