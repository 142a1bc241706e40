"""Structured Streaming forms of the windowed operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, at: str, by: str, value: str, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(window_start, by, n, mean): fixed windows; events later than the watermark are dropped.

    The same expression serves a stream and a static table.
    """
    source = events.withWatermark(at, late) if events.isStreaming else events
    out = source.groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "mean")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now, batch by batch, and end; resumes from the checkpoint folder."""
    return df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
