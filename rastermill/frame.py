"""RasterFrame: a wide pixel DataFrame (time?, row, col, bands) with its grid; every method is lazy and returns a new frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import radiometry
from .functions.expr import clean
from .grid import Bounds, GridMeta, parse_crs
from .operators import align, classify, combine, focal, index, masks, sample, temporal, tiles, vector
from .sources import reader


@dataclass(frozen=True)
class RasterFrame:
    df: DataFrame
    grid: GridMeta

    # layout
    @property
    def bands(self) -> list[str]:
        return list(self.grid.bands)

    @property
    def keys(self) -> list[str]:
        return [k for k in ("time", "row", "col") if k in self.df.columns]

    def _like(self, df: DataFrame, bands=None, grid: GridMeta | None = None) -> RasterFrame:
        grid = grid or self.grid
        return RasterFrame(df, grid.replace(bands=tuple(bands)) if bands is not None else grid)

    @classmethod
    def open(cls, spark, path, **options) -> RasterFrame:
        return cls(*reader.open_raster(spark, path, **options))

    @classmethod
    def from_long(cls, df: DataFrame, grid: GridMeta, bands: list[str]) -> RasterFrame:
        """(time?, band, row, col, value) to columns: conditional maxima, no pivot pass over the bands."""
        keys = [k for k in ("time", "row", "col") if k in df.columns]
        return cls(df.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands]), grid.replace(bands=tuple(bands)))

    def to_long(self) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in self.bands])
        return self.df.select(*self.keys, F.inline(pairs))

    @classmethod
    def from_numpy(cls, spark, array, grid: GridMeta, bands: list[str] | None = None) -> RasterFrame:
        import numpy as np
        import pandas as pd

        names = bands or [str(i + 1) for i in range(len(array))]
        y, x = np.mgrid[0 : array.shape[1], 0 : array.shape[2]]
        rows = pd.DataFrame({"row": y.ravel(), "col": x.ravel()} | {b: array[k].ravel().astype(float) for k, b in enumerate(names)})
        df = spark.createDataFrame(rows).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")} | {b: clean(b, grid.nodata) for b in names})
        return cls(df, grid.replace(bands=tuple(names), nrows=array.shape[1], ncols=array.shape[2]))

    def to_numpy(self):
        """For images that fit the driver."""
        import numpy as np

        out = np.full((len(self.bands), self.grid.nrows, self.grid.ncols), np.nan)
        rows = self.df.select("row", "col", *self.bands).toPandas()
        for k, b in enumerate(self.bands):
            out[k, rows["row"], rows["col"]] = rows[b].astype(float)
        return out

    def select(self, *bands: str) -> RasterFrame:
        return self._like(self.df.select(*self.keys, *bands), bands)

    def rename(self, names: dict[str, str]) -> RasterFrame:
        return self._like(self.df.withColumnsRenamed(names), [names.get(b, b) for b in self.bands])

    def with_bands(self, **columns: Column) -> RasterFrame:
        return self._like(self.df.withColumns(columns), [*self.bands, *[c for c in columns if c not in self.bands]])

    def band_op(self, other: RasterFrame, op: str) -> RasterFrame:
        return self._like(combine.band_arithmetic(self.df, other.df, self.bands, op))

    __add__ = lambda self, o: self.band_op(o, "+")
    __sub__ = lambda self, o: self.band_op(o, "-")
    __mul__ = lambda self, o: self.band_op(o, "*")
    __truediv__ = lambda self, o: self.band_op(o, "/")

    # band math
    def index(self, name: str, **options) -> RasterFrame:
        options = {"nodata": self.grid.nodata, "scale": self.grid.scale} | options
        return self._like(self.df.select(*self.keys, index.index(name, **options)), [name])

    def norm_diff(self, b1: str, b2: str, **options) -> RasterFrame:
        return self._like(self.df.select(*self.keys, index.norm_diff(b1, b2, **options)), ["norm_diff"])

    def tasseled_cap(self, sensor: str | None = None, **options) -> RasterFrame:
        return self._like(self.df.select(*self.keys, *index.tasseled_cap(sensor or self.grid.sensor, **options)), ["brightness", "greenness", "wetness"])

    def set_nodata(self, src=None, dst=None, out_range=None, scale=1.0, offset=0.0) -> RasterFrame:
        return self._like(index.set_nodata(self.df, self.bands, src, dst, out_range, scale, offset), grid=self.grid.replace(nodata=dst, scale=1.0, offset=0.0))

    def mask_nodata(self) -> RasterFrame:
        return self if self.grid.nodata is None else self._like(index.mask_nodata(self.df, self.bands, self.grid.nodata))

    def replace(self, to_replace: dict) -> RasterFrame:
        return self._like(index.replace_values(self.df, self.bands, to_replace))

    def compare(self, op: str, value: float, binary: bool = False) -> RasterFrame:
        return self._like(index.compare(self.df, self.bands, op, value, binary))

    def bandpass(self, sensor: str | None = None, **options) -> RasterFrame:
        return self._like(index.bandpass(self.df, sensor or self.grid.sensor, self.bands, **options))

    def linear_transform(self, scale: dict, offset: dict) -> RasterFrame:
        return self._like(index.linear_transform(self.df, scale, offset))

    # space
    def recode(self, band, shapes, to_replace) -> RasterFrame:
        return self._like(vector.recode(self.df, band, shapes, self.grid, to_replace))

    def mask(self, shapes, keep="in", all_touched=True) -> RasterFrame:
        return self._like(vector.mask(self.df, self.bands, shapes, self.grid, keep, all_touched))

    def keep_where(self, condition: Column) -> RasterFrame:
        return self._like(masks.keep_where(self.df, self.bands, condition))

    def clip(self, bounds, shapes=None, expand_by: int = 0) -> RasterFrame:
        return RasterFrame(*vector.clip(self.df, self.bands, Bounds.parse(bounds), self.grid, shapes, expand_by))

    def subset(self, row, col, height, width, circle=False) -> RasterFrame:
        return RasterFrame(*vector.subset(self.df, self.grid, row, col, height, width, circle))

    def align_to(self, target: GridMeta, resampling: str = "nearest") -> RasterFrame:
        return RasterFrame(align.align(self.df, self.grid, target, self.bands, resampling), target.replace(bands=self.grid.bands))

    def transform_crs(self, crs, res=None, resampling: str = "nearest") -> RasterFrame:
        """Warped to another CRS (an EPSG number, PROJ or WKT text), or to a given grid."""
        return self.align_to(crs if isinstance(crs, GridMeta) else self.grid.in_crs(parse_crs(crs), res), resampling)

    def moving(self, band: str, stat="mean", w=3, **options) -> RasterFrame:
        return self._like(focal.moving(self.df, band, self.grid.nrows, self.grid.ncols, stat, w, **options), [band])

    def extract(self, points: DataFrame) -> DataFrame:
        return vector.extract_points(self.df, self.bands, points, self.grid)

    def extract_wide(self, places: DataFrame, **options) -> DataFrame:
        return vector.extract_wide(self.df, self.bands, places, self.grid, **options)

    def class_stats(self, label="targ") -> DataFrame:
        return classify.class_stats(self.df, self.bands, label)

    def sample(self, n: int, seed: int = 1) -> DataFrame:
        return sample.with_coordinates(sample.random_sample(self.df, n, seed), self.grid)

    def calc_area(self, band: str, values, op="eq", units="km2") -> DataFrame:
        return combine.area(self.df, band, values, self.grid.cell_area, op, units)

    def to_polygons(self, band: str, connectivity=4) -> DataFrame:
        return vector.polygonize(self.df, band, self.grid, connectivity)

    # time
    def stats(self, names: list[str], band: str) -> RasterFrame:
        return self._like(temporal.series_stats(self.df, names, band), names)

    def composite(self, freq: str, how: str = "median") -> RasterFrame:
        return self._like(temporal.composite(self.df, freq, how, self.bands))

    # radiometry, models, user functions
    def toar_to_sr(self, sensor=None, **angles) -> RasterFrame:
        return self._like(radiometry.toar_to_sr(self.df, self.bands, sensor or self.grid.sensor, **angles))

    def norm_brdf(self, **options) -> RasterFrame:
        return self._like(radiometry.norm_brdf(self.df, self.bands, **options))

    def norm_topo(self, **options) -> RasterFrame:
        return self._like(radiometry.norm_topo(self.df, self.bands, **options))

    def fit(self, estimator, label="targ"):
        return classify.fit(self.df, self.bands, estimator, label)

    def predict(self, model) -> RasterFrame:
        return self._like(classify.predict(self.df, self.bands, model), [*self.bands, "targ"])

    def map_tiles(self, fn: Callable, out: list[str], halo: int = 0, tile: int = 256) -> RasterFrame:
        return self._like(tiles.map_tiles(self.df, self.bands, self.grid, fn, out, halo, tile), out)

    def apply(self, module: tiles.TimeModule, tile: int = 256) -> RasterFrame:
        return self._like(tiles.apply_module(self.df, self.bands, self.grid, module, tile), module.outputs())

    # sinks
    def save(self, path: str, **options) -> None:
        if reader.FORMATS.get(reader.extension(path)) == "geotiff":
            reader.write_geotiff(self.df, self.grid, self.bands, path, **options)
        else:
            reader.write_layout(self.df, self.grid, path, **options)

    def to_view(self, name: str) -> None:
        self.df.createOrReplaceTempView(name)
