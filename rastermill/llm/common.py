"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch that a Python worker gets at once (unless the session says otherwise); a longer row stands alone.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package (same path, as on one machine or a shared file system; elsewhere ship it with
    --py-files), get batches bounded by bytes, and give freed arrays back to the system, so that idle workers hold little."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    env["TOKENIZERS_PARALLELISM"] = "false"
    for k, v in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_MMAP_THRESHOLD_", str(4 << 20))):
        env.setdefault(k, v)
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found:
        if held.isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rastermill-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: files of shuffles that no query holds any more go then, which else comes at any time.

    A checkpointed table that is still referred to holds its own shuffles; the last query run is held until another has run.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(uri: str):
    """(file system, path) of a URI or a plain local path."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_bounds(df: DataFrame, key: str, n: int) -> list:
    """Up to n-1 ascending bounds that cut a numeric key into ranges of about equal row counts; reads the key only."""
    if n < 2:
        return []
    got = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()[0]
    return sorted(set(got or []))


def range_bucket(key: str, bounds: list):
    """Number of bounds at or below the key (binary search over a constant array); null keys come first."""
    if not bounds:
        return F.lit(0)
    array, low = F.lit(bounds), F.lit(0)

    def step(size: int):
        def up(at):
            return F.when((at + size <= F.lit(len(bounds))) & (F.get(array, at + (size - 1)) <= F.col(key)), at + size).otherwise(at)

        return up

    for bit in reversed(range(len(bounds).bit_length())):
        low = F.get(F.transform(F.array(low), step(1 << bit)), F.lit(0))  # each step's operand is computed once
    return F.coalesce(low, F.lit(0)).cast("int")
