"""Mosaics, stacks, merges, areas: unions and hash aggregates on integer pixel keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col
from ..grid import GridMeta, common_bounds
from .align import align
from .index import condition

HOW = {"min": F.min, "max": F.max, "mean": F.avg}


def shift_to(df: DataFrame, own: GridMeta, target: GridMeta) -> DataFrame:
    """Same cell size and phase: row and col renumbered, pixels outside dropped."""
    dr, dc = round((target.top - own.top) / own.celly), round((own.left - target.left) / own.cellx)
    moved = df.withColumns({"row": (F.col("row") + dr).cast("int"), "col": (F.col("col") + dc).cast("int")})
    return moved.filter(F.col("row").between(0, target.nrows - 1) & F.col("col").between(0, target.ncols - 1))


def on_grid(df: DataFrame, own: GridMeta, target: GridMeta, bands: list[str], resampling: str = "nearest") -> DataFrame:
    """Pixels on the target's cells: renumbered where only whole cells lie between the grids, else resampled (cell size, phase or CRS differ)."""
    keys = [k for k in ("time", "row", "col") if k in df.columns]
    held = df.select(*keys, *bands)
    if own.same_grid(target):
        return held
    return shift_to(held, own, target) if own.same_phase(target) else align(held, own, target, bands, resampling)


def mosaic(frames: list[tuple[DataFrame, GridMeta]], bands: list[str], overlap: str = "max", bounds_by: str = "reference", resampling: str = "nearest") -> tuple[DataFrame, GridMeta]:
    """Overlaps reduced by min, max or mean over what is not missing; images on other grids are resampled to the first one's cells."""
    first = frames[0][1]
    grid = GridMeta.from_bounds(common_bounds([g for _, g in frames], bounds_by), first.res, first.crs, bands=tuple(bands), nodata=first.nodata)
    keys = [k for k in ("time", "row", "col") if k in frames[0][0].columns]
    united = reduce(DataFrame.unionByName, [on_grid(d, g, grid, bands, resampling) for d, g in frames])
    return united.groupBy(*keys).agg(*[HOW[overlap](b).alias(b) for b in bands]), grid


def concat_time(frames: list[tuple[object, DataFrame]], bands: list[str], overlap: str = "max") -> DataFrame:
    """One slice for each distinct time; images of one time are mosaicked."""
    named = [d.withColumn("time", F.lit(t).cast("timestamp")).select("time", "row", "col", *bands) for t, d in frames]
    united = reduce(DataFrame.unionByName, named)
    times = [t for t, _ in frames]
    return united if len(set(times)) == len(times) else united.groupBy("time", "row", "col").agg(*[HOW[overlap](b).alias(b) for b in bands])


def stack_bands(frames: list[DataFrame]) -> DataFrame:
    """Bands side by side on the pixels that all have."""
    keys = [k for k in ("time", "row", "col") if k in frames[0].columns]
    return reduce(lambda a, b: a.join(b, keys), frames)


def merge_duplicates(frames: list[DataFrame], bands: list[str], zero_is_missing: bool = False) -> DataFrame:
    """Mean of repeated (time, row, col)."""
    value = lambda b: F.nullif(col(b), F.lit(0.0)) if zero_is_missing else col(b)
    return reduce(DataFrame.unionByName, frames).groupBy("time", "row", "col").agg(*[F.avg(value(b)).alias(b) for b in bands])


def drop_empty_times(df: DataFrame, bands: list[str]) -> DataFrame:
    full = df.groupBy("time").agg(sum((F.count(b) for b in bands[1:]), F.count(bands[0])).alias("n")).filter("n > 0").select("time")
    return df.join(full, "time", "left_semi")


def area(df: DataFrame, band: str, values: list[float], cell_area: float, op: str = "eq", units: str = "km2") -> DataFrame:
    """value, area for each value: cells that satisfy op times their area; one pass, partial sums."""
    per = cell_area * {"km2": 1e-6, "ha": 1e-4}[units]
    counts = df.agg(*[F.count(F.when(condition(band, op, v), 1)).alias(f"n{i}") for i, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(float(v)).alias("value"), (F.col(f"n{i}") * per).alias("area")) for i, v in enumerate(values)])
    return counts.select(F.inline(pairs)).orderBy("value")


def area_by_class(df: DataFrame, band: str, cell_area: float, units: str = "km2") -> DataFrame:
    per = cell_area * {"km2": 1e-6, "ha": 1e-4}[units]
    return df.filter(col(band).isNotNull()).groupBy(col(band).alias("value")).agg((F.count(F.lit(1)) * per).alias("area"))


def band_arithmetic(a: DataFrame, b: DataFrame, bands: list[str], op: str) -> DataFrame:
    """Two images band by band on the pixels they share (+ - * /)."""
    keys = [k for k in ("time", "row", "col") if k in a.columns and k in b.columns]
    x, y = a.alias("x"), b.alias("y")
    do = {"+": lambda p, q: p + q, "-": lambda p, q: p - q, "*": lambda p, q: p * q, "/": F.try_divide}[op]
    return x.join(y, keys).select(*keys, *[do(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in bands])


def reduce_bands(df: DataFrame, bands: list[str], how: str) -> DataFrame:
    """One value from a pixel's bands: min, max, mean, sum, count; missing bands are passed over."""
    held = F.filter(F.array(*bands), lambda v: v.isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda s, v: s + v)
    out = {"min": F.array_min(held), "max": F.array_max(held), "sum": F.when(F.size(held) > 0, total), "mean": F.try_divide(total, F.size(held)), "count": F.size(held)}[how]
    return df.withColumn(how, out)
