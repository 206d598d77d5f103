"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this a dot product is a loop over the array and no longer generated code.
UNROLLED = 256


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_with(v: Column, q: Sequence[float]) -> Column:
    """Inner product with a constant vector."""
    if len(q) > UNROLLED:
        return dot(v, F.array(*[F.lit(float(x)) for x in q]))
    terms = [F.get(v, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(q)]
    while len(terms) > 1:  # a balanced tree, so that expressions stay shallow
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n == 0, x).otherwise(x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def pool(v: Column, width: int) -> Column:
    """Means of neighbouring groups; the length must be a multiple of ``width``."""
    f = (F.size(v) / F.lit(width)).cast("int")
    ok = F.size(v) % width == 0
    means = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.slice(doubles(v), i * f + 1, f), F.lit(0.0), lambda s, x: s + x) / f
    )
    return F.when(ok, means).otherwise(F.raise_error(F.lit(f"length is not a multiple of {width}")).cast("array<double>"))
