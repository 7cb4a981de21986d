"""Opening and writing rasters: parquet layouts with a grid side file, GeoTIFF, scene manifests, catalog search, metadata files."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import current
from ..functions.expr import clean
from ..grid import Bounds, GridMeta, common_bounds
from ..operators import combine, masks
from ..sensors import COLLECTION_SCALING

#: Extensions by reader.
FORMATS = {".parquet": "layout", "": "layout", ".tif": "geotiff", ".tiff": "geotiff"}
UNSUPPORTED = (".img", ".kea", ".vrt", ".jp2", ".hgt", ".hdf", ".h5", ".nc", ".zarr")


def extension(path: str) -> str:
    return m[0].lower() if (m := re.search(r"\.[A-Za-z0-9]+$", path.rstrip("/").rsplit("/", 1)[-1])) else ""


def write_layout(df: DataFrame, grid: GridMeta, path: str, mode: str = "errorifexists", partition_by: str | None = None, compression: str = "zstd") -> None:
    """Pixels as parquet with tile keys (so that windows prune files and row groups), and the grid as one row of text.

    partition_by: "time" or "tile" folders; within tasks rows are sorted by tile, so row-group statistics are tight.
    """
    tiled = df.withColumns({"trow": F.floor(F.col("row") / grid.tile).cast("int"), "tcol": F.floor(F.col("col") / grid.tile).cast("int")})
    keys = [k for k in ("time",) if k in df.columns]
    writer = tiled.repartition(*keys, "trow", "tcol").sortWithinPartitions(*keys, "trow", "tcol", "row", "col").write.mode(mode).option("compression", compression)
    (writer.partitionBy(*(keys if partition_by == "time" else ["trow"])) if partition_by else writer).parquet(f"{path}/pixels")
    df.sparkSession.createDataFrame([(grid.json(),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/grid")


def read_grid(spark: SparkSession, path: str) -> GridMeta:
    return GridMeta.from_json(spark.read.text(f"{path}/grid").first()[0])


def read_layout(spark: SparkSession, path: str, bands: list[str] | None = None, bounds=None) -> tuple[DataFrame, GridMeta]:
    """bounds become range predicates on tile keys and cells, which reach the parquet scan."""
    grid, df = read_grid(spark, path), spark.read.parquet(f"{path}/pixels")
    if bounds is not None:
        r, c, h, w = grid.window_of(bounds)
        t = grid.tile
        df = df.filter(F.col("trow").between(r // t, (r + h - 1) // t) & F.col("tcol").between(c // t, (c + w - 1) // t) & F.col("row").between(r, r + h - 1) & F.col("col").between(c, c + w - 1))
        df = df.withColumns({"row": F.col("row") - r, "col": F.col("col") - c})
        grid = grid.at_window(r, c, h, w)
    keys = [k for k in ("time", "row", "col") if k in df.columns]
    return df.select(*keys, *(bands or grid.bands)), grid.replace(bands=tuple(bands or grid.bands))


def read_geotiff(spark: SparkSession, path: str, bands: list[str] | None = None, nodata=None) -> tuple[DataFrame, GridMeta]:
    """Pixels of a file, or of all files of a folder that are parts of one grid.

    Tasks read the headers and give the driver a line for each file; cells are decoded block by block, a file in a task.
    """
    from .geotiff import blocks, header

    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"grid": [header(bytes(raw))[1].json() for raw in batch["content"]]})

    grids = [GridMeta.from_json(r.grid) for r in files.mapInPandas(heads, "grid string").collect()]
    if not grids:
        raise OSError(f"no files in {path!r}")
    if not all(g.same_phase(grids[0]) for g in grids):
        raise ValueError("the files of a folder are parts of one grid; open images of other grids as a list of paths")
    first = grids[0]
    whole = first if len(grids) == 1 else GridMeta.from_bounds(common_bounds(grids, "union"), first.res, first.crs, bands=first.bands, nodata=first.nodata, dtype=first.dtype)
    names = list(current().band_names(bands, None, len(first.bands)))
    missing = current().value("nodata", nodata, first.nodata)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for raw in map(bytes, batch["content"]):
                layout, own = header(raw)
                down, right = round((whole.top - own.top) / own.celly), round((own.left - whole.left) / own.cellx)
                for r, c, block in blocks(raw, layout, own):
                    for r0 in range(0, block.shape[1], 256):  # a few rows at a time
                        part = block[:, r0 : r0 + 256]
                        y, x = np.mgrid[r + r0 + down : r + r0 + down + part.shape[1], c + right : c + right + part.shape[2]]
                        yield pd.DataFrame({"row": y.ravel().astype(np.int32), "col": x.ravel().astype(np.int32)} | {b: part[k].ravel().astype(float) for k, b in enumerate(names)})

    df = files.mapInPandas(run, "row int, col int, " + ", ".join(f"`{b}` double" for b in names))
    return df.withColumns({b: clean(b, missing) for b in names}), whole.replace(bands=tuple(names), nodata=missing)


def write_geotiff(df: DataFrame, grid: GridMeta, bands: list[str], path: str, dtype: str = "float64", compress: bool = True, block: int | None = None) -> None:
    """One file, for an image that fits a task; with block a folder of files of block x block cells, each written by the task that has
    its cells.  A repeated task writes the same file again; blocks without any cell have none."""
    from .geotiff import encode

    fill = grid.nodata if grid.nodata is not None else (np.nan if dtype.startswith("float") else 0)
    side = block or max(grid.nrows, grid.ncols)

    def run(key, rows):
        import pandas as pd
        from pyarrow import fs

        r, c = int(key[0]) * side, int(key[1]) * side
        own = grid.at_window(r, c, min(side, grid.nrows - r), min(side, grid.ncols - c))
        data = np.full((len(bands), own.nrows, own.ncols), fill, dtype)
        for k, b in enumerate(bands):
            v = rows[b].astype(float).to_numpy()
            data[k, rows["row"] - r, rows["col"] - c] = np.where(np.isnan(v), fill, v).astype(dtype)
        system, place = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
        if block:
            system.create_dir(place, recursive=True)
            place = f"{place}/block-{key[0]}-{key[1]}.tif"
        with system.open_output_stream(place) as out:
            out.write(encode(data, own.replace(dtype=dtype), compress))
        return pd.DataFrame({"n": [len(rows)]})

    tiles = [F.floor(F.col(k) / side).cast("int").alias(f"__{k}") for k in ("row", "col")]
    df.select("row", "col", *bands).groupBy(*tiles).applyInPandas(run, "n long").agg(F.sum("n")).collect()


def open_raster(spark: SparkSession, path, bands: list[str] | None = None, times: list | None = None, mosaic: bool = False, overlap: str = "max", bounds_by: str = "reference", bounds=None, stack_dim: str = "time", nodata=None, target: GridMeta | None = None, resampling: str = "nearest"):
    """One path, or several as a mosaic or stacked on time or band; (DataFrame, GridMeta).

    Images come onto one grid: the target's, or what the settings' ref_* say of the first image's own; several images without either
    take the first one's.  Other cell sizes, phases and CRSs are resampled, whole-cell shifts are not.
    """
    wanted = lambda own: target or current().resolve_grid(own)
    if isinstance(path, str):
        df, own = _open_one(spark, path, bands, bounds, nodata)
        goal = wanted(own)
        return (df, own) if own.same_grid(goal) else (combine.on_grid(df, own, goal, list(own.bands), resampling), goal.replace(bands=own.bands, nodata=own.nodata))
    opened = [_open_one(spark, p, bands if stack_dim != "band" or mosaic else None, bounds, nodata) for p in path]
    names, first = list(opened[0][1].bands), opened[0][1]
    goal = wanted(first).replace(bands=first.bands, nodata=first.nodata)
    if mosaic:
        if not first.same_grid(goal):
            opened = [(combine.on_grid(d, g, goal, names, resampling), goal) for d, g in opened]
        return combine.mosaic(opened, names, overlap, bounds_by, resampling)
    on_goal = [combine.on_grid(d, g, goal, list(g.bands), resampling) for d, g in opened]
    if stack_dim == "band":
        labels = list(bands or [str(i + 1) for i in range(len(opened))])
        frames = [d.select("row", "col", F.col(g.bands[0]).alias(b)) for d, (_, g), b in zip(on_goal, opened, labels, strict=True)]
        return combine.stack_bands(frames), goal.replace(bands=tuple(labels))
    return combine.concat_time(list(zip(times or filename_times(path), on_goal, strict=True)), names, overlap), goal


def _open_one(spark: SparkSession, path: str, bands, bounds, nodata) -> tuple[DataFrame, GridMeta]:
    """One file or layout on its own grid, cut at bounds."""
    kind = extension(path)
    if kind in UNSUPPORTED or kind not in FORMATS:
        raise OSError(f"no reader for {kind or path!r} files")
    if FORMATS[kind] == "layout":
        return read_layout(spark, path, bands, bounds)
    df, grid = read_geotiff(spark, path, bands, nodata)
    if bounds is None:
        return df, grid
    from ..operators.vector import clip

    return clip(df, list(grid.bands), Bounds.parse(bounds), grid)


def filename_times(paths: Iterable[str]) -> list[str]:
    """Dates in file names (yyyymmdd), else 1970-01-01 and on."""
    found = [re.search(r"(\d{4})(\d{2})(\d{2})", p.rsplit("/", 1)[-1]) for p in paths]
    return ["-".join(m.groups()) if m else f"1970-01-{i:02d}" for i, m in enumerate(found, 1)]


MANIFEST = "scene_id string, path string, collection string, time timestamp, left double, bottom double, right double, top double, cloud_cover double"


def search(manifest: DataFrame, collection: str | None = None, bounds=None, start=None, end=None, max_cloud: float | None = None) -> DataFrame:
    """Scenes of a manifest that overlap bounds in a period below a cloud cover, oldest first."""
    out = manifest if collection is None else manifest.filter(F.col("collection") == collection)
    if bounds is not None:
        b = Bounds.parse(bounds)
        out = out.filter((F.col("left") <= b.right) & (F.col("right") >= b.left) & (F.col("bottom") <= b.top) & (F.col("top") >= b.bottom))
    out = out if start is None else out.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    out = out if end is None else out.filter(F.col("time") <= F.lit(end).cast("timestamp"))
    return (out if max_cloud is None else out.filter(F.col("cloud_cover") < max_cloud)).orderBy("time", "scene_id")


def manifest_bounds(manifest: DataFrame, by: str = "union") -> DataFrame:
    """left, bottom, right, top of the union or intersection of all scenes."""
    low, high = (F.min, F.max) if by == "union" else (F.max, F.min)
    return manifest.agg(low("left").alias("left"), low("bottom").alias("bottom"), high("right").alias("right"), high("top").alias("top"))


def scale_collection(df: DataFrame, bands: list[str], collection: str, qa: str | None = None) -> DataFrame:
    """Catalog pixels to reflectance in [0, 1], cloudy ones masked by the collection's own quality band."""
    from ..operators.index import set_nodata

    gain, offset, nodata = COLLECTION_SCALING.get(collection, (1e-4, 0.0, 0))
    out = set_nodata(df, bands, nodata, None, (0, 1), gain, offset)
    if qa is None:
        return out
    clear = masks.landsat_clear(qa) if collection.startswith("landsat") else masks.fmask_clear(qa) if collection.startswith("hls") else masks.scl_clear(qa)
    return masks.keep_where(out, bands, clear).drop(qa)


def landsat_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY = value lines of an MTL file."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\w+)\s*=\s*\"?([^\"]*)\"?\s*$", 1).alias("k"), F.regexp_extract("value", r"^\s*(\w+)\s*=\s*\"?([^\"]*)\"?\s*$", 2).alias("v"))
    return {r.k: r.v.strip() for r in rows.filter("k <> '' and k not in ('GROUP', 'END_GROUP')").collect()}


def landsat_coefficients(meta: dict[str, str]) -> dict:
    """Gains and biases by band number, solar zenith, sensor and date."""
    pick = lambda name: {int(m[1]): float(v) for k, v in meta.items() if (m := re.fullmatch(rf"{name}_BAND_(\d+)", k))}
    return {"radiance_mult": pick("RADIANCE_MULT"), "radiance_add": pick("RADIANCE_ADD"), "reflectance_mult": pick("REFLECTANCE_MULT"), "reflectance_add": pick("REFLECTANCE_ADD"), "sza": 90.0 - float(meta["SUN_ELEVATION"]), "sensor": meta.get("SPACECRAFT_ID"), "date": meta.get("DATE_ACQUIRED")}


def sentinel_angles(xml: str) -> dict:
    """EPSG, shape, corner, and 5 km sun and mean viewing angle grids of a tile's metadata (schemas psd-14 and psd-15)."""
    if not re.search(r"psd-1[45]", xml):
        raise ValueError("only schemas psd-14 and psd-15 are known")
    root = ElementTree.fromstring(xml)
    named = lambda tag: [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == tag]
    grid = lambda e: np.array([[float(v) for v in r.text.split()] for r in e.iter() if r.tag.rsplit("}", 1)[-1] == "VALUES"])
    under = lambda e, tag: grid(next(x for x in e if x.tag.rsplit("}", 1)[-1] == tag))
    sun = named("Sun_Angles_Grid")[0]
    views = named("Viewing_Incidence_Angles_Grids")
    out = {"crs": int(named("HORIZONTAL_CS_CODE")[0].text.split(":")[-1]), "sza": under(sun, "Zenith"), "saa": under(sun, "Azimuth")}
    for size in named("Size"):
        out[f"shape_{size.get('resolution')}"] = tuple(int(next(x for x in size if x.tag.rsplit("}", 1)[-1] == t).text) for t in ("NROWS", "NCOLS"))
    corner = named("Geoposition")[0]
    out["corner"] = tuple(float(next(x for x in corner if x.tag.rsplit("}", 1)[-1] == t).text) for t in ("ULX", "ULY"))
    if views:
        out |= {k: np.nanmean([under(v, t) for v in views], axis=0) for k, t in (("vza", "Zenith"), ("vaa", "Azimuth"))}
    return out


def landsat_urls(scene_id, bands: list[int], base: str = "https://storage.googleapis.com/gcp-public-data-landsat"):
    """Array column of band addresses of a scene id such as LC08_L1TP_224078_20200518_20200518_01_RT."""
    parts = F.split(scene_id, "_")
    folder = F.concat_ws("/", F.lit(base), F.get(parts, F.lit(0)), F.lit("01"), F.substring(F.get(parts, F.lit(2)), 1, 3), F.substring(F.get(parts, F.lit(2)), 4, 3), scene_id)
    return F.array(*[F.concat(folder, F.lit("/"), scene_id, F.lit(f"_B{n}.TIF")) for n in bands], F.concat(folder, F.lit("/"), scene_id, F.lit("_MTL.txt")))


def sentinel2_urls(safe_id, granule, bands: list[str], base: str = "https://storage.googleapis.com/gcp-public-data-sentinel-2"):
    """Array column of band addresses of a product such as S2A_MSIL1C_20180109T135101_N0206_R024_T21HVB_20180109T171608 and its
    granule folder, then the metadata's address."""
    parts = F.split(safe_id, "_")
    tile, date = F.get(parts, F.lit(5)), F.get(parts, F.lit(2))
    zone = F.concat_ws("/", F.substring(tile, 2, 2), F.substring(tile, 4, 1), F.substring(tile, 5, 2))
    folder = F.concat_ws("/", F.lit(base), F.lit("tiles"), zone, F.concat(safe_id, F.lit(".SAFE")), F.lit("GRANULE"), granule)
    images = [F.concat(folder, F.lit("/IMG_DATA/"), tile, F.lit("_"), date, F.lit(f"_B{b}.jp2")) for b in bands]
    return F.array(*images, F.concat(folder, F.lit("/MTD_TL.xml")))


def load_series(frames: list[DataFrame], bands: list[str], in_range: tuple[float, float], out_range: tuple[float, float], nodata: float = 65535) -> DataFrame:
    """Pixels of many files (time, row, col, bands): cut to [0, max(in_max, nodata)], nodata as 0, scaled by out_max / in_max,
    cut to out_range; images of one day give their maximum."""
    from functools import reduce

    from ..functions.expr import clip

    def one(b):
        v = clip(F.coalesce(clean(b), F.lit(0.0)), 0, max(in_range[1], nodata))
        return clip(F.when(v == nodata, 0.0).otherwise(v) * (out_range[1] / in_range[1]), *out_range)

    united = reduce(DataFrame.unionByName, [d.select("time", "row", "col", *[one(b).alias(b) for b in bands]) for d in frames])
    return united.groupBy(F.to_timestamp(F.to_date("time")).alias("time"), "row", "col").agg(*[F.max(b).alias(b) for b in bands])


def footprints(spark: SparkSession, grids: list[GridMeta]) -> DataFrame:
    """A row for each image: source, crs, left, bottom, right, top."""
    rows = [("|".join(g.sources), g.crs, g.bounds.left, g.bounds.bottom, g.bounds.right, g.bounds.top) for g in grids]
    return spark.createDataFrame(rows, "source string, crs int, left double, bottom double, right double, top double")


def write_vector(shapes: DataFrame, path: str, geometry: str = "wkt", mode: str = "errorifexists") -> None:
    """Polygons as parquet, or as GeoJSON features (a line each) where the path ends in .geojson."""
    if extension(path) != ".geojson":
        shapes.write.mode(mode).parquet(path)
        return
    rings = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(geometry, r"^POLYGON \(", "["), r"\)$", "]"), r"(-?[0-9.e+]+) (-?[0-9.e+]+)", r"[$1, $2]"), r"\((\[)", "[$1")
    rings = F.regexp_replace(rings, r"\]\)", "]]")
    others = F.to_json(F.struct(*[c for c in shapes.columns if c != geometry]))
    shapes.select(F.concat(F.lit('{"type": "Feature", "properties": '), others, F.lit(', "geometry": {"type": "Polygon", "coordinates": '), rings, F.lit("}}")).alias("value")).write.mode(mode).text(path)


def composite_catalog(manifest: DataFrame, read, bands: list[str], collection: str, qa: str, freq: str, how: str = "median", **where) -> DataFrame:
    """Scenes found in a manifest, read (a function of the found manifest to pixels), scaled, masked and composited by period."""
    from ..operators.temporal import composite

    scenes = search(manifest, collection, **where)
    return composite(scale_collection(read(scenes), bands, collection, qa), freq, how, bands)
