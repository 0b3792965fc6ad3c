"""Streams of events to log lines and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.web import log_line


def lines(events: DataFrame) -> DataFrame:
    """event_id, line: the log line of each event; works on batches and streams alike."""
    none = F.lit(None).cast("string")
    request = F.concat(F.lit("GET /"), "event_type", F.lit(" HTTP/1.1"))
    return events.select("event_id", log_line(none, F.col("user_id"), F.col("ts"), request, F.lit(200), F.octet_length("props"), none, none).alias("line"))


def counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; on a stream, windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
