"""Streams of pixels: first-order statistics by window and region, and features of slides as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiforge.functions.sqltext import KEYS


def windowed_intensity(pixels: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, extrema, sum and mean of intensity in each region and window; rows later than the watermark are left out."""
    stream = pixels.withWatermark(time, late)
    i = F.col("inten").cast("double")
    return stream.groupBy(F.window(time, window), "slide_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min(i).alias("lo"), F.max(i).alias("hi"), F.sum(i).alias("total"), F.avg(i).alias("mean"))


def featurize_stream(pixels: DataFrame, sink: str, features: str, checkpoint: str, featurize: Callable[[DataFrame, str], DataFrame]):
    """Starts a query that featurizes each micro-batch of complete slides and appends Parquet to sink.

    A batch is written to a folder of its own, so that a batch which runs again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        featurize(batch.select(*KEYS, "x", "y", "z", "inten"), features).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return pixels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
