"""Small driver-side tables as plan literals, without Python on the executors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: list[tuple], **kinds: str) -> DataFrame:
    """``rows`` as a table with the given columns and types."""
    text = json.dumps([dict(zip(kinds, r)) for r in rows])
    struct = ",".join(f"`{k}`:{v}" for k, v in kinds.items())
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{struct}>>")))
