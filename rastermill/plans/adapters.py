"""Star-schema tables read as rasters, so that every operator has data and a SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridMeta

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
WIDTH = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark, sf_dir) -> DataFrame:
    """embeddings as one six-band image of reflectances, 25 columns wide, with class label."""
    bands = [((F.get("embedding", F.lit(i)).cast("double") + 1.0) / 2.0).alias(b) for i, b in enumerate(BANDS)]
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / WIDTH).cast("int").alias("row"), (F.col("vec_id") % WIDTH).cast("int").alias("col"), *bands, F.col("label").cast("int").alias("label"))


def image_grid(df: DataFrame) -> GridMeta:
    """The image's height is read from its rows (one value)."""
    return GridMeta(600000.0, 4000000.0, 30.0, 30.0, df.agg(F.max("row")).first()[0] + 1, WIDTH, 32621, BANDS, sensor="l7")


def numbers(spark, sf_dir) -> DataFrame:
    """lineitem as an image series of whole numbers: time, band, row, col, value."""
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("time"), F.col("l_linenumber").cast("int").alias("band"), F.floor(key / 128).cast("int").alias("row"), (key % 128).cast("int").alias("col"), F.col("l_quantity").alias("value"))


def series(spark, sf_dir) -> DataFrame:
    """orders as a time series of one band: time, row, col, value."""
    key = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"), F.floor(key / 16).cast("int").alias("row"), (key % 16).cast("int").alias("col"), F.col("o_totalprice").alias("value"), "o_orderkey")


def daily(spark, sf_dir) -> DataFrame:
    """events as a daily five-band cube: time, row, col and a band for each event type."""
    key, kinds = F.col("user_id"), {"click": "blue", "view": "green", "purchase": "red", "signup": "nir", "error": "swir1"}
    means = [F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(b) for k, b in kinds.items()]
    return table(spark, sf_dir, "events").groupBy(F.to_timestamp(F.to_date("ts")).alias("time"), F.floor(key / 16).cast("int").alias("row"), (key % 16).cast("int").alias("col")).agg(*means)


def quality(spark, sf_dir) -> DataFrame:
    """part as bit-packed quality values and scene classes."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(key / 64).cast("int").alias("row"), (key % 64).cast("int").alias("col"), ((key * 37) % 65536).cast("int").alias("qa"), (key % 12).cast("int").alias("scl"), F.col("p_retailprice").alias("value"))


def angled(spark, sf_dir) -> DataFrame:
    """The image with sun and view angles and a surface, all in degrees and metres by arithmetic on cells."""
    r, c = F.col("row"), F.col("col")
    return image(spark, sf_dir).withColumns({"sza": 25.0 + (r * 7 + c) % 30, "saa": 120.0 + (r + c * 3) % 60, "vza": 1.0 + (r + c) % 9, "vaa": 100.0 + (r * 5 + c * 11) % 200, "elev": ((r * 13 + c * 7) % 50) * 10.0, "slope": (r * 3 + c) % 40 * 1.0, "aspect": (r * 17 + c * 29) % 360 * 1.0, "cloud": F.when((r * 5 + c * 3) % 11 == 0, 1).otherwise(0)})
