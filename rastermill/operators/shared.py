"""What several operators need: reliable checkpoints in the folder that driver and executors share, and components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and the master is local (tests) a new local folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="rastermill-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows read from a table in the shared folder: their size is then known, which a checkpoint's plan only estimates."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, head) of every node in a link (a, b): the least node that it reaches.

    Larger neighbours are hung on the least one around a node, then smaller ones, in turn (both keep what is connected), until no edge
    changes.  Every round is written and read again.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(hung.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.toDF("u", "v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("head")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
        seen = now
