"""First-seen rows and windowed counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze


def first_seen(stream: DataFrame, text: str = "text", event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows whose squeezed text has not been seen; with event_time the state is bounded by the watermark."""
    rows = stream.withColumn("digest", F.sha2(squeeze(F.col(text)), 256))
    if event_time:
        return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["digest"]).drop("digest")
    return rows.dropDuplicates(["digest"]).drop("digest")


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"))
