"""An extension: figures over a stream of captures or metrics, with watermarks. Batch parity doesn't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, time: str, by: list[str], value: str, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """count, mean and maximum by event-time window; works on batches and streams alike."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top"))
    return out.select(F.col("window.start").alias("win_start"), F.col("window.end").alias("win_end"), *by, "n", "mean", "top")
