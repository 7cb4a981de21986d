"""Random, systematic and stratified pixel samples, reproducible by seed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridMeta, x_of, y_of
from .index import condition
from .vector import remove_near_points


def _draw(seed: int):
    """60 bits of a digest, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(seed), "row", "col")), 1, 15), 16, 10).cast("long")


def with_coordinates(df: DataFrame, grid: GridMeta) -> DataFrame:
    return df.withColumns({"x": x_of(grid), "y": y_of(grid)})


def random_sample(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n pixels without replacement, all if there are fewer: the least by hash, a top-n in each task and then over all."""
    return df.orderBy(_draw(seed), "row", "col").limit(n)


def systematic_sample(df: DataFrame, grid: GridMeta, spacing: float) -> DataFrame:
    """Every int(spacing / cell)-th row and column."""
    dy, dx = max(1, int(spacing / grid.celly)), max(1, int(spacing / grid.cellx))
    return df.filter((F.col("row") % dy == 0) & (F.col("col") % dx == 0))


def stratum(band: str, text: str):
    """"ge,0.5" or "gt,0.2;le,0.5"."""
    out = F.lit(True)
    for part in text.split(";"):
        op, value = re.split(r"\s*,\s*", part.strip())
        out = out & condition(band, op, float(value))
    return out


def stratified_sample(df: DataFrame, band: str, strata: dict[str, float], seed: int = 1) -> DataFrame:
    """stratum and pixels: a count, or a fraction below 1, of each stratum (the first that fits)."""
    names = list(strata)
    label = F.lit(None).cast("string")
    for s in reversed(names):
        label = F.when(stratum(band, s), F.lit(s)).otherwise(label)
    marked = df.withColumn("stratum", label).filter("stratum is not null")
    # exact sizes first (a row a stratum); then a bound on the draw lets about twice the wanted rows pass to the rank within a stratum
    sizes = {r[0]: r[1] for r in marked.groupBy("stratum").count().collect()}
    wanted = {s: min(n, round(n * strata[s]) if 0 < strata[s] < 1 else int(strata[s])) for s, n in sizes.items()}
    span, wide = 1 << 40, 2.0
    draw = F.pmod(_draw(seed), F.lit(span))
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("stratum"))
    while wanted:
        bound = {s: int(min(span, span * (wide * (k + 64) / sizes[s]))) for s, k in wanted.items()}
        passed = marked.filter(draw < pick(bound))
        short = [r[0] for r in passed.groupBy("stratum").count().collect() if r[1] < wanted[r[0]]] or set(k for k, v in wanted.items() if v) - {r[0] for r in passed.select("stratum").distinct().collect()}
        if not short:
            break
        wide *= 8
    if not wanted:
        return marked
    # a stratum taken by half or more would still be one task: it is dealt by ranges of the draw, whose counts say where ranks begin
    ranges = 1 << 10
    part = F.floor(draw / (span // ranges)).cast("int")
    counts = passed.groupBy("stratum", part.alias("__part")).count().withColumn("__ahead", F.sum("count").over(Window.partitionBy("stratum").orderBy("__part")) - F.col("count"))
    inside = Window.partitionBy("stratum", "__part").orderBy(draw, "row", "col")
    ranked = passed.withColumn("__part", part).withColumn("__rank", F.row_number().over(inside)).join(F.broadcast(counts.drop("count")), ["stratum", "__part"])  # at most 1024 rows a stratum
    return ranked.filter(F.col("__rank") + F.col("__ahead") <= pick(wanted)).select("stratum", *df.columns)


def spaced_sample(df: DataFrame, grid: GridMeta, n: int, min_dist: float, seed: int = 1, attempts: int = 10) -> DataFrame:
    """Up to n pixels no two within min_dist: draws grow until enough stay or attempts are over."""
    for k in range(1, attempts + 1):
        drawn = with_coordinates(random_sample(df, n * 2**k, seed), grid).withColumn("id", F.row_number().over(Window.orderBy(_draw(seed), "row", "col")))
        kept = remove_near_points(drawn, min_dist)
        if k == attempts or kept.count() >= n:
            break
    return kept.orderBy("id").limit(n).drop("id")
