"""Chat messages: which of them are queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that address everybody.
EVERYBODY = ("@everyone", "@here")


def queries_of(messages: DataFrame, own: str, channel_id: int) -> DataFrame:
    """``messages`` (author, channel_id, is_direct, mentions, content) that ask something, with ``query``.

    Others' messages, sent directly or in the channel, that mention nobody and are not blank.
    """
    here = F.col("is_direct") | (F.col("channel_id") == channel_id)
    nobody = (F.size("mentions") <= 0) & ~F.col("content").rlike("|".join(EVERYBODY))
    query = F.regexp_replace("content", r"(?U)^\s+|\s+\z", "")
    return messages.where((F.col("author") != own) & here & nobody).withColumn("query", query).where("query <> ''")
