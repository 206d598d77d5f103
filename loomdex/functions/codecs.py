"""Columns as text and back: tags, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_tags(tags: Column) -> Column:
    """JSON array; no tags are an empty array."""
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def decode_tags(encoded: Column) -> Column:
    """Tags of a JSON array; none of null or empty text."""
    given = F.nullif(F.trim(encoded), F.lit(""))
    return F.coalesce(F.from_json(given, "array<string>"), F.array().cast("array<string>"))


def split_tags(joined: Column, mark: str = ",") -> Column:
    """Tags that a mark separates, without blanks around them; null text has none."""
    return F.transform(F.split(F.coalesce(joined, F.lit("")), mark), lambda x: F.trim(x))


def encode_date(day: Column) -> Column:
    """yyyy-mm-dd."""
    return F.date_format(day, "yyyy-MM-dd")


def decode_date(text: Column) -> Column:
    """The date of yyyy-mm-dd; null for anything else, null and empty text included."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))
