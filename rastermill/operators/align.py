"""Grid alignment: target cells are mapped to source cells and joined on integer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import GridMeta, lonlat_to_xy, x_of, xy_to_lonlat, y_of


def target_cells(spark, grid: GridMeta) -> DataFrame:
    """row and col of every cell, generated in parallel."""
    return spark.range(grid.nrows * grid.ncols).select(F.floor(F.col("id") / grid.ncols).cast("int").alias("row"), (F.col("id") % grid.ncols).cast("int").alias("col"))


def _source_place(source: GridMeta, target: GridMeta):
    """Fractional source (row, col) of a target cell's centre, counted from cell centres."""
    x, y = x_of(target), y_of(target)
    if source.crs != target.crs:
        x, y = lonlat_to_xy(*xy_to_lonlat(x, y, target.crs), source.crs)
    return (F.lit(source.top) - y) / source.celly - 0.5, (x - F.lit(source.left)) / source.cellx - 0.5


def _cubic(t):
    """Catmull-Rom weights of the four neighbours at -1, 0, 1, 2."""
    return [((-0.5 * t + 1.0) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1.0, ((-1.5 * t + 2.0) * t + 0.5) * t, (0.5 * t - 0.5) * t * t]


def align(df: DataFrame, source: GridMeta, target: GridMeta, bands: list[str], resampling: str = "nearest") -> DataFrame:
    """Pixels of df on the target grid (row, col, bands; with time if there): nearest, bilinear or cubic.

    Same grid: returned as is.  Missing neighbours are left out and the weights of the others rescaled; a cell whose nearest
    neighbour is outside has no row.
    """
    keys = [k for k in ("time",) if k in df.columns]
    if source.same_grid(target):
        return df.select(*keys, "row", "col", *bands)
    r, c = _source_place(source, target)
    cells = target_cells(df.sparkSession, target).withColumns({"__r": r, "__c": c})
    near = {"__nr": F.floor(F.col("__r") + 0.5).cast("int"), "__nc": F.floor(F.col("__c") + 0.5).cast("int")}
    cells = cells.withColumns(near).filter(F.col("__nr").between(0, source.nrows - 1) & F.col("__nc").between(0, source.ncols - 1))
    values = df.select(*keys, F.col("row").alias("__sr"), F.col("col").alias("__sc"), *bands)
    if resampling == "nearest":
        return cells.join(values, (F.col("__nr") == F.col("__sr")) & (F.col("__nc") == F.col("__sc"))).select(*keys, "row", "col", *bands)
    r0, c0 = F.floor("__r"), F.floor("__c")
    fr, fc = F.col("__r") - r0, F.col("__c") - c0
    if resampling == "bilinear":
        offsets, wr, wc = (0, 1), [1 - fr, fr], [1 - fc, fc]
    elif resampling == "cubic":
        offsets, wr, wc = (-1, 0, 1, 2), _cubic(fr), _cubic(fc)
    else:
        raise ValueError(f"resampling is nearest, bilinear or cubic, not {resampling!r}")
    steps = F.array(*[F.struct((r0 + i).cast("int").alias("__sr"), (c0 + j).cast("int").alias("__sc"), (wr[a] * wc[b]).alias("__w")) for a, i in enumerate(offsets) for b, j in enumerate(offsets)])
    spread = cells.select("row", "col", F.inline(steps)).filter("__w <> 0")
    joined = spread.join(values, ["__sr", "__sc"])
    mean = lambda b: F.try_divide(F.sum(F.col(b) * F.col("__w")), F.sum(F.when(F.col(b).isNotNull(), F.col("__w")))).alias(b)
    return joined.groupBy(*keys, "row", "col").agg(*map(mean, bands))


def coarsen(df: DataFrame, bands: list[str], factor: int, how: str = "mean") -> DataFrame:
    """factor x factor cells to one (a rollup of the pyramid)."""
    f = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median}[how]
    keys = [k for k in ("time",) if k in df.columns]
    return df.groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(*[f(b).alias(b) for b in bands])
