"""Tokens, stems and similarity, as column expressions and for driver-side strings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's ``\w`` is ASCII; this is the Unicode word.
WORD = r"[\p{L}\p{N}_]+"


def stem(w: Column) -> Column:
    """Plural stripping of a lower-case word."""
    n = F.length(w)

    def cut(k: int) -> Column:
        return F.left(w, n - F.lit(k))

    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies"), F.when(w.endswith("eies") | w.endswith("aies"), w).otherwise(F.concat(cut(3), F.lit("y"))))
        .when(w.endswith("es"), F.when(w.endswith("aes") | w.endswith("ees") | w.endswith("oes"), w).otherwise(cut(1)))
        .when(w.endswith("s"), F.when(w.endswith("us") | w.endswith("ss"), w).otherwise(cut(1)))
        .otherwise(w)
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def tokenize(text: Column) -> Column:
    """Array of stemmed words; null text has none."""
    return F.transform(words(text), stem)


#: Plural endings, the words that keep them, letters dropped, letters put instead.
ENDINGS = (("ies", ("eies", "aies"), 3, "y"), ("es", ("aes", "ees", "oes"), 1, ""), ("s", ("us", "ss"), 1, ""))


def stem_word(w: str) -> str:
    w = w.lower()
    if len(w) <= 3:
        return w
    for ending, exempt, drop, add in ENDINGS:
        if w.endswith(ending):
            return w if w.endswith(exempt) else w[:-drop] + add
    return w


def tokens_of(text: str | None) -> list[str]:
    return [stem_word(w) for w in re.findall(r"\b\w+\b", (text or "").lower())]


def similarity(a: Column, b: Column) -> Column:
    """Indel ratio in percent: 200 * LCS / (length a + length b); two empty strings are alike."""
    width = F.length(b)
    letters = F.split(b, "")

    def next_row(row: Column, c: Column) -> Column:
        step = F.aggregate(
            F.sequence(F.lit(1), width),
            F.array(F.lit(0)),
            lambda new, j: F.concat(
                new,
                F.array(F.when(F.get(letters, j - 1) == c, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(new, -1)))),
            ),
        )
        return F.when(width > 0, step).otherwise(F.array(F.lit(0)))

    chars = F.filter(F.split(a, ""), lambda c: c != "")
    start = F.array_repeat(F.lit(0), width + 1)
    lcs = F.element_at(F.aggregate(chars, start, next_row), -1)
    total = F.length(a) + width
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / total)


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, a machine word of rows at a time (Python's integers have no fixed width)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def fast_similarity(a: Column, b: Column) -> Column:
    """The numbers of ``similarity`` over Arrow batches."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([200.0 * lcs_length(s, t) / (len(s) + len(t)) if s or t else 100.0 for s, t in zip(x, y)])

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(a, b)


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def quote(literal: str) -> str:
    """A Java regex for exactly this text."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"
