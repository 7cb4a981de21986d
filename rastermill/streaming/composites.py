"""Composites kept up to date as scenes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pixel_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet pixels (time, row, col, values) of files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_composite(pixels: DataFrame, value: str, window: str = "16 days", delay: str = "2 days", slide: str | None = None) -> DataFrame:
    """time, row, col, and mean, min, max, n of value in each window; pixels later than the watermark are dropped, state with them."""
    spans = F.window("time", window, slide) if slide else F.window("time", window)
    grouped = pixels.withWatermark("time", delay).groupBy(spans.alias("span"), "row", "col")
    made = grouped.agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    return made.select(F.col("span.start").alias("time"), "row", "col", "mean", "min", "max", "n")


def sink(frame: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends finished windows as parquet, exactly once by the checkpoint."""
    writer = frame.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
