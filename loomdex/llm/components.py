"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.skew import look_up
from loomdex.runtime import discard, stash


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Hooking and pointer jumping: each round every node looks at the grandparents of its
    neighbours and hooks itself and its parent below the smallest, then jumps to its
    grandparent. Rounds grow with the logarithm of the diameter. Each round is written to the
    shared folder. Hubs, the parents of many nodes and the neighbours of many, are looked up without a shuffle.
    Self loops, repeated edges and nulls are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    both = stash(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    start = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    degrees = stash(start.select(F.col("u").alias("v"), "n", F.least("u", "m").alias("p")), "degrees")
    labels, total = degrees.select(F.col("v").alias("u"), "p"), None
    while True:
        now = labels.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
        up = labels.select(F.col("u").alias("p"), F.col("p").alias("g"))
        grand = stash(look_up(labels, up, "p").select("u", "p", "g"), "grand")
        least = look_up(both, grand.select(F.col("u").alias("v"), "g"), "v", degrees).groupBy("u").agg(F.min("g").alias("m"))
        step = grand.join(least, "u").select(
            F.explode(F.array(
                F.struct(F.col("u"), F.least("g", "m").alias("p")),
                F.struct(F.col("p").alias("u"), F.col("m").alias("p")),
            )).alias("x")
        )
        fresh = stash(step.select("x.u", "x.p").groupBy("u").agg(F.min("p").alias("p")), "labels")
        discard(labels)
        discard(grand)
        labels = fresh
    discard(both)
    return labels.select(F.col("u").alias("node"), F.col("p").alias("root"))
