"""Deduplication of a stream of entries by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.functions import scalars as S


def first_arrivals(stream: DataFrame, time: str, within: str = "1 hour") -> DataFrame:
    """Entries whose content has not been seen ``within`` that time; state is dropped behind the watermark."""
    hashed = stream.withColumn("hash", S.content_hash(F.col("content")))
    return hashed.withWatermark(time, within).dropDuplicatesWithinWatermark(["hash"])


def volume(stream: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Entries and bytes that arrived in each window."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("w.start", "w.end", "n", "bytes")
