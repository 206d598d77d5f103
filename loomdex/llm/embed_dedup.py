"""Near-copies among embeddings: int8 tile products with rigorous error bounds.

Vectors are scaled to unit length, dealt to blocks by hash, and every pair of blocks is a tile.
A block is quantised once; its full-precision vectors go to a file in the shared folder, and tiles get its int8 form q,
the scales s, and e, the lengths of v - s*q. The product of two unit vectors differs from s*s'*(q.q') by at most
e' + e*(1 + e'). Pairs above the threshold by more than that are links, pairs below it by more are not. Only if pairs
within the bound are left does a tile read the full vectors, and computes those pairs anew in double precision.

A tile returns one row per linked vector (its number of links and the root of a spanning
forest), never pairs. Exact copies enter once, with their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.components import connected_components
from loomdex.llm.files import Opened, Rolling
from loomdex.llm.skew import look_up
from loomdex.runtime import new_path, stash

STRIP = 512
EXACT = 1 << 15
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 forms, scales and error lengths of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def normalise(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products; float32 holds them exactly up to 1040 components (127 * 127 * 1040 < 2 ** 24)."""
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    return a.astype(kind) @ b.astype(kind).T


class Forest:
    """Union by smallest index over arrays of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, r: np.ndarray, c: np.ndarray) -> None:
        while len(r):
            a, b = self.up[r], self.up[c]
            open_ = a != b
            if not open_.any():
                return
            r, c, a, b = r[open_], c[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jump := self.up[self.up], self.up):
                self.up = jump


@dataclass
class Block:
    """Quantised vectors, the copies that each stands for, and a way to the full unit vectors."""

    q: np.ndarray
    scale: np.ndarray
    error: np.ndarray
    copies: np.ndarray
    full: Callable[[], np.ndarray]

    @classmethod
    def of(cls, unit: np.ndarray, copies: np.ndarray) -> Block:
        return cls(*quantise(unit), copies, lambda: unit)


def tile_links(x: Block, y: Block | None, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the vectors of x and y (y None: among x): summed copies per vector, and each one's root."""
    same = y is None
    y = x if same else y
    shift = 0 if same else len(x.q)
    n = np.zeros(len(x.q) + (0 if same else len(y.q)), np.int64)
    forest = Forest(len(n))
    worst = float(y.error.max(initial=0.0))
    sy32 = y.scale.astype(np.float32)
    for i in range(0, len(x.q), STRIP):
        rows = slice(i, i + STRIP)
        first = i if same else 0
        p = products(x.q[rows], y.q[first:])
        floor = (at - (worst + x.error[rows] * (1 + worst)) - 1e-4) / x.scale[rows]
        r, c = np.nonzero(p * sy32[first:] >= floor[:, None].astype(np.float32))
        r, c = r + i, c + first
        if same:
            keep = c > r
            r, c = r[keep], c[keep]
        for j in range(0, len(r), EXACT):
            a, b = r[j : j + EXACT], c[j : j + EXACT]
            near = p[a - i, b - first].astype(np.float64) * x.scale[a] * y.scale[b]
            bound = y.error[b] + x.error[a] * (1 + y.error[b]) + SLACK
            link = near - bound >= at
            open_ = np.nonzero(~link & (near + bound >= at))[0]
            if len(open_):
                link[open_] = np.einsum("ij,ij->i", x.full()[a[open_]], y.full()[b[open_]]) >= at
            a, b = a[link], b[link]
            np.add.at(n, a, y.copies[b])
            np.add.at(n, b + shift, x.copies[a])
            forest.join(a, b + shift)
    return n, forest.up


def linked_vectors(vectors: DataFrame, at: float = 0.95, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    neither do vectors of different lengths. Copies count as linked to each other.
    kept: vec_id = component_id. Null ids are linked like others but never smallest.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    fine = F.coalesce(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    kind = "f8" if "double" in rows.schema["embedding"].dataType.simpleString() else "f4"
    nodes = rows.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = stash(nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "vectors")
    # a block holds ``block`` vectors on average, small tables still use sixteen blocks
    dims = nodes.groupBy("dim").agg(F.count("*").alias("rows")).select("dim", F.greatest(F.ceil(F.col("rows") / block), F.least(F.lit(16), F.ceil(F.col("rows") / 256))).cast("int").alias("blocks"))
    dealt = nodes.join(dims, "dim").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    folder = new_path(spark, "full-vectors")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["embedding"].to_numpy()).astype(kind)
        q, scale, error = quantise(normalise(v))
        out = Rolling(folder, ".vec", 1)
        name, _ = out.put(v.tobytes())
        out.close()
        return pd.DataFrame({
            **{c: [int(pdf[c].iloc[0])] for c in ("dim", "block", "blocks")}, "file": [name], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()],
            "copies": [pdf["n"].to_numpy(np.int64).tobytes()], "q": [q.tobytes()], "scale": [scale.tobytes()], "error": [error.tobytes()],
        })

    packed = stash(
        dealt.select("dim", "block", "blocks", "node", "n", "embedding").groupBy("dim", "block", "blocks")
        .applyInPandas(pack, "dim int, block int, blocks int, file string, nodes binary, copies binary, q binary, scale binary, error binary"), "blocks")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = packed.withColumn("other", F.explode(others)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        d, i, j = (int(pdf[k].iloc[0]) for k in ("dim", "i", "j"))
        part = {}
        for row in pdf.itertuples():
            def full(name=row.file, held=[]) -> np.ndarray:
                if not held:
                    held.append(normalise(np.frombuffer(Opened(folder).whole(name), kind).reshape(-1, d)))
                return held[0]

            copies, scale, error = (np.frombuffer(x, t) for x, t in ((row.copies, np.int64), (row.scale, np.float64), (row.error, np.float64)))
            part[int(row.block)] = np.frombuffer(row.nodes, np.int64), Block(np.frombuffer(row.q, np.int8).reshape(-1, d), scale, error, copies, full)
        if i not in part or j not in part:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        (na, x), (nb, y) = part[i], part[j]
        n, up = tile_links(x, None if i == j else y, at)
        ids = na if i == j else np.concatenate([na, nb])
        got = np.nonzero(n)[0]
        return pd.DataFrame({"node": ids[got], "links": n[got], "root": ids[up[got]]})

    found = stash(tiles.drop("blocks", "other").groupBy("dim", "i", "j").applyInPandas(multiply, "node long, links long, root long"), "tiles")
    roots = connected_components(found, "node", "root")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.drop("dim").join(degree, "node", "left").join(roots, "node", "left")
    comp = F.coalesce("root", "node")
    small = joined.groupBy(comp.alias("root")).agg(F.min("least").alias("component_id"))
    per = joined.withColumn("root", comp).join(small, "root").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    per = stash(per, "per")  # a row per distinct vector
    linked = look_up(rows.where(fine), per, "embedding", nodes).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
