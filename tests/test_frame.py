import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.frame import RasterFrame
from rastermill.grid import GridMeta
from rastermill.operators import classify, combine, focal, sample, temporal, tiles, vector
from rastermill.plans.pipeline import Pipeline
from rastermill.sources import geotiff, reader
from rastermill.streaming import composites

GRID = GridMeta(600000.0, 4000000.0, 30.0, 30.0, 12, 17, nodata=None, tile=16)


def frame(spark, bands=("blue", "green", "red", "nir"), seed=1):
    return RasterFrame.from_numpy(spark, np.random.default_rng(seed).random((len(bands), 12, 17)), GRID, list(bands))


def test_known_indices(spark):
    f = RasterFrame.from_numpy(spark, np.array([[[0.09]], [[0.11]], [[0.21]]]), GRID, ["blue", "red", "nir"])
    assert f.index("evi").to_numpy()[0, 0, 0] == pytest.approx(2.5 * 0.1 / (0.21 + 0.66 - 0.675 + 1))
    assert f.index("evi2").to_numpy()[0, 0, 0] == pytest.approx(2.5 * 0.1 / (0.21 + 1 + 0.264))
    two = RasterFrame.from_numpy(spark, np.array([[[0.4]], [[0.1]]]), GRID, ["b1", "b2"])
    assert two.norm_diff("b1", "b2").to_numpy()[0, 0, 0] == pytest.approx(-0.6)


def test_missing_stays_missing(spark):
    a = np.array([[[255.0, 10.0, 0.0]], [[20.0, 255.0, 0.0]]])
    f = RasterFrame.from_numpy(spark, a, GRID.replace(nodata=255), ["red", "nir"])
    rows = f.index("ndvi").df.orderBy("col").collect()
    assert [r.ndvi for r in rows] == [None, None, None]  # sentinel, sentinel, zero denominator
    assert f.tasseled_cap("qb", bands=("red", "nir", "red", "nir")).df.filter("col = 0").first().brightness is None


def test_arithmetic_and_layouts(spark):
    f = frame(spark)
    assert np.allclose((f + f).to_numpy(), 2 * f.to_numpy()) and np.allclose((f / f).to_numpy(), 1)
    again = RasterFrame.from_long(f.to_long(), f.grid, f.bands)
    assert np.allclose(again.to_numpy(), f.to_numpy())
    assert f.select("red").rename({"red": "b"}).bands == ["b"]


def reflected(a, w, fn):
    view = np.lib.stride_tricks.sliding_window_view(np.pad(a, w // 2, mode="symmetric"), (w, w))
    return fn(view, axis=(2, 3))


@pytest.mark.parametrize("stat,fn", [("mean", np.nanmean), ("min", np.nanmin), ("max", np.nanmax), ("std", np.nanstd), ("var", np.nanvar)])
@pytest.mark.parametrize("tile", [4, 1024])
def test_focal_as_numpy(spark, stat, fn, tile):
    a = np.random.default_rng(2).random((12, 17))
    a[3, 4] = a[0, 0] = np.nan
    f = RasterFrame.from_numpy(spark, a[None], GRID, ["v"])
    got = f.moving("v", stat, 5, tile=tile).to_numpy()[0]
    assert np.allclose(got, reflected(a, 5, fn))


def test_focal_errors(spark):
    with pytest.raises(ValueError):
        frame(spark).moving("red", "mean", 4)
    with pytest.raises(ValueError):
        focal.moving(frame(spark).df, "red", 12, 17, "mode", 3)


def test_layout_and_geotiff_round_trip(spark, tmp_path):
    f = frame(spark)
    f.save(f"{tmp_path}/cube")
    back = RasterFrame.open(spark, f"{tmp_path}/cube")
    assert back.grid == f.grid and np.allclose(back.to_numpy(), f.to_numpy())
    part = RasterFrame.open(spark, f"{tmp_path}/cube", bands=["red"], bounds=(600060, 3999880, 600150, 3999940))
    assert part.df.count() == 6 and "PushedFilters" in part.df._jdf.queryExecution().toString()
    f.save(f"{tmp_path}/image.tif")
    tif = RasterFrame.open(spark, f"{tmp_path}/image.tif", bands=f.bands)
    assert np.allclose(tif.to_numpy(), f.to_numpy()) and tif.grid.same_grid(f.grid)
    with pytest.raises(OSError):
        RasterFrame.open(spark, "x.jp2")


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("compress", [True, False])
def test_tiff_codec(dtype, compress):
    a = (np.random.default_rng(1).random((3, 150, 70)) * 100).astype(dtype)
    data, grid = geotiff.decode(geotiff.encode(a, GRID.replace(nrows=150, ncols=70, nodata=9), compress))
    assert (data == a).all() and data.dtype == a.dtype and grid.crs == 32621 and grid.nodata == 9 and grid.transform == GRID.transform


def test_open_many(spark, tmp_path):
    a, b = frame(spark, ("v",), 1), frame(spark, ("v",), 2)
    for f, name in ((a, "s_20200101.tif"), (b, "s_20200201.tif")):
        f.save(f"{tmp_path}/{name}")
    paths = [f"{tmp_path}/s_20200101.tif", f"{tmp_path}/s_20200201.tif"]
    cube, _ = reader.open_raster(spark, paths, bands=["v"])
    assert {str(r.time)[:10] for r in cube.select("time").distinct().collect()} == {"2020-01-01", "2020-02-01"}
    both, grid = reader.open_raster(spark, paths, bands=["v"], mosaic=True, overlap="mean")
    assert np.allclose(RasterFrame(both, grid).to_numpy(), (a.to_numpy() + b.to_numpy()) / 2)
    stacked, grid = reader.open_raster(spark, paths, bands=["x", "y"], stack_dim="band")
    assert np.allclose(RasterFrame(stacked, grid).to_numpy(), np.concatenate([a.to_numpy(), b.to_numpy()]))


def test_touched_cells_include_centres_and_edges(spark):
    shapes = vector.polygons(spark, [(1, 5, [(600010, 3999995), (600050, 3999995), (600050, 3999965)])])
    inside = {(r.row, r.col) for r in vector.cells_of(shapes, GRID).collect()}
    touched = {(r.row, r.col) for r in vector.cells_of(shapes, GRID, True).collect()}
    assert inside < touched == {(0, 0), (0, 1), (1, 1)}


def test_polygonize_covers_every_cell_once(spark):
    a = np.array([[1, 1, 2], [1, 2, 2], [1, 1, 1], [3, 1, 3]], float)
    f = RasterFrame.from_numpy(spark, a[None], GridMeta(0, 4, 1, 1, 4, 3), ["v"])
    rows = f.to_polygons("v").collect()
    assert sorted((r.value, r.cells) for r in rows) == [(1.0, 7), (2.0, 3), (3.0, 1), (3.0, 1)]
    square = next(r for r in rows if r.value == 3 and "(0 1" in r.wkt)
    assert square.wkt == "POLYGON ((0 1, 1 1, 1 0, 0 0, 0 1))"
    ring = RasterFrame.from_numpy(spark, np.array([[[1, 1, 1], [1, 0, 1], [1, 1, 1]]], float), GridMeta(0, 3, 1, 1, 3, 3), ["v"])
    assert next(r for r in ring.to_polygons("v").collect() if r.value == 1).wkt.count("(") == 3  # with a hole
    diagonal = RasterFrame.from_numpy(spark, np.array([[[1, 0], [0, 1]]], float), GridMeta(0, 2, 1, 1, 2, 2), ["v"])
    assert diagonal.to_polygons("v", 8).count() == 2 and diagonal.to_polygons("v", 4).count() == 4


def test_samples(spark):
    df = frame(spark).df
    one, two = (sorted(map(tuple, sample.random_sample(df, 20, s).select("row", "col").collect())) for s in (1, 2))
    assert len(set(one)) == 20 and one != two and one == sorted(map(tuple, sample.random_sample(df, 20, 1).select("row", "col").collect()))
    got = sample.stratified_sample(df, "red", {"ge,0.5": 7, "lt,0.5": 0.25}).collect()
    n = df.filter("red < 0.5").count()
    assert sum(r.stratum == "ge,0.5" for r in got) == 7 and sum(r.stratum == "lt,0.5" for r in got) == round(n * 0.25)
    spread = sample.spaced_sample(df, GRID, 6, 100.0).collect()
    assert all((a.x - b.x) ** 2 + (a.y - b.y) ** 2 > 100**2 for i, a in enumerate(spread) for b in spread[:i]) and len(spread) == 6


def test_resample_labels_as_pandas(spark):
    import pandas as pd

    days = pd.date_range("2022-01-05", periods=60, freq="3D")
    df = spark.createDataFrame([(d.to_pydatetime(), 0, 0, float(i)) for i, d in enumerate(days)], "time timestamp, row int, col int, value double")
    series = pd.Series(np.arange(60.0), index=days)
    for freq in ("D", "MS", "QS", "YS", "W", "15D", "2W", "3W", "2MS"):
        want = series.resample(freq).mean().dropna()
        got = {r.time: r.value for r in temporal.composite(df, freq, "mean").collect()}
        assert got == pytest.approx({t.to_pydatetime(): v for t, v in want.items()}), freq


def test_tiles_do_not_change_results(spark):
    f = frame(spark)
    blur = lambda cube, _: np.pad(np.lib.stride_tricks.sliding_window_view(cube[0], (3, 3), axis=(1, 2)).mean((3, 4)), ((0, 0), (1, 1), (1, 1)))
    small, whole = (f.map_tiles(blur, f.bands, 1, t).to_numpy() for t in (5, 100))
    assert np.allclose(small, whole) and np.allclose(whole[2], reflected(f.to_numpy()[2], 3, np.mean))


class Spread(tiles.TimeModule):
    names = ("spread",)

    def calculate(self, array):
        return array[:, 0].max(0) - array[:, 0].min(0)


class Mean(tiles.TimeModule):
    names = ("mean",)

    def calculate(self, array):
        return array[:, 0].mean(0)


def test_time_modules(spark):
    df = combine.concat_time([("2020-01-01", frame(spark, ("v",), 1).df), ("2020-01-02", frame(spark, ("v",), 2).df)], ["v"])
    got = RasterFrame(df, GRID.replace(bands=("v",))).apply(Spread() + Mean(), 8).to_numpy()
    a, b = (frame(spark, ("v",), s).to_numpy()[0] for s in (1, 2))
    assert np.allclose(got[0], abs(a - b)) and np.allclose(got[1], (a + b) / 2)


def test_shift_is_found(spark):
    a = np.random.default_rng(1).random((40, 40))
    f = RasterFrame.from_numpy(spark, np.stack([a, np.roll(a, (3, -2), (0, 1))]), GridMeta(0, 0, 1, 1, 40, 40), ["ref", "tar"])
    moved, dr, dc = tiles.coregister(f.df, "ref", "tar", f.grid)
    assert (dr, dc) == (3, -2) and moved.filter("abs(ref - tar) > 1e-9").count() == 0


def test_fusion_keeps_an_unchanged_scene(spark):
    f = frame(spark, ("fine", "coarse"))
    same = f.df.withColumn("next", F.col("coarse"))
    got = RasterFrame(tiles.starfm(same, GRID, "fine", "coarse", "next", 5, 8), GRID.replace(bands=("fused",))).to_numpy()[0]
    assert np.isfinite(got).all() and np.abs(got - f.to_numpy()[0]).mean() < 0.2
    assert tiles.improphe(f.df, GRID, "fine", "coarse", 5, 8).count() == 12 * 17


def test_fit_then_predict_is_fit_predict(spark):
    f = frame(spark)
    shapes = vector.polygons(spark, [(1, 3, [(600000, 4000000), (600240, 4000000), (600240, 3999640), (600000, 3999640)]), (2, 8, [(600240, 4000000), (600510, 4000000), (600510, 3999640), (600240, 3999640)])])
    labelled = classify.with_labels(f.df.withColumn("red", F.when(F.col("col") < 8, 0.1).otherwise(0.9)), shapes, GRID)
    est = classify.estimator("random_forest", numTrees=5, seed=1)
    one = classify.fit_predict(labelled, ["red", "nir"], est)
    two = classify.predict(labelled, ["red", "nir"], classify.fit(labelled, ["red", "nir"], est))
    assert one.exceptAll(two).count() == 0
    assert one.filter("(col < 8 and targ <> '3.0') or (col >= 8 and targ <> '8.0')").count() == 0
    holes = labelled.withColumn("nir", F.when(F.col("row") > 2, F.col("nir")))
    assert classify.fit_predict(holes, ["red", "nir"], est).filter("(row <= 2) <> (targ is null)").count() == 0
    with pytest.raises(NotImplementedError):
        classify.estimator("unet")


def test_pipeline_runs_in_order(spark):
    p = Pipeline({"a": frame(spark)}).then("ndvi", lambda f: f.index("ndvi"), "a").then("high", lambda f: f.compare("gt", 0.2))
    made = p.run()
    assert p.describe() == "a -> ndvi\nndvi -> high" and made["high"].df.filter("ndvi <= 0.2").count() == 0


def test_streamed_windows_match_a_batch(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 00:00:00", d % 2, 0, float(d)) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "t string, row int, col int, value double").select(F.col("t").cast("timestamp").alias("time"), "row", "col", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = composites.windowed_composite(composites.pixel_stream(spark, f"{tmp_path}/in", df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")), "value", "7 days", "1 day")
    q = composites.sink(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    got = {(str(r.time), r.row): (r["mean"], r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(str(r.s), r.row): (r.m, r.n) for r in df.groupBy(F.window("time", "7 days").start.alias("s"), "row").agg(F.avg("value").alias("m"), F.count("value").alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


MTL = 'GROUP = X\n  SPACECRAFT_ID = "LANDSAT_8"\n  SUN_ELEVATION = 57.73214399\n  REFLECTANCE_MULT_BAND_4 = 2.75e-05\n  REFLECTANCE_ADD_BAND_4 = -0.2\n  DATE_ACQUIRED = 2020-01-27\nEND_GROUP = X\n'


def test_metadata_files(spark, tmp_path):
    (tmp_path / "mtl.txt").write_text(MTL)
    got = reader.landsat_coefficients(reader.landsat_metadata(spark, f"{tmp_path}/mtl.txt"))
    assert got["sza"] == pytest.approx(32.26785601) and got["reflectance_mult"] == {4: 2.75e-05} and got["sensor"] == "LANDSAT_8"
    values = "<Values_List>" + "<VALUES>30 30 30</VALUES>" * 3 + "</Values_List>"
    xml = f'<a xmlns="psd-14"><HORIZONTAL_CS_CODE>EPSG:32635</HORIZONTAL_CS_CODE><Size resolution="10"><NROWS>10980</NROWS><NCOLS>10980</NCOLS></Size><Geoposition resolution="10"><ULX>300000</ULX><ULY>4400040</ULY></Geoposition><Sun_Angles_Grid><Zenith>{values}</Zenith><Azimuth>{values.replace("30", "150")}</Azimuth></Sun_Angles_Grid></a>'
    angles = reader.sentinel_angles(xml)
    assert angles["crs"] == 32635 and angles["shape_10"] == (10980, 10980) and angles["saa"].mean() == 150 and angles["corner"] == (300000, 4400040)
    with pytest.raises(ValueError):
        reader.sentinel_angles(xml.replace("psd-14", "psd-99"))


def test_product_addresses(spark):
    row = spark.range(1).select(reader.sentinel2_urls(F.lit("S2A_MSIL1C_20180109T135101_N0206_R024_T21HVB_20180109T171608"), F.lit("L1C_T21HVB_A013323_20180109T135101"), ["02", "8A"]).alias("u")).first().u
    assert row[0].endswith("tiles/21/H/VB/S2A_MSIL1C_20180109T135101_N0206_R024_T21HVB_20180109T171608.SAFE/GRANULE/L1C_T21HVB_A013323_20180109T135101/IMG_DATA/T21HVB_20180109T135101_B02.jp2") and len(row) == 3


def test_vectors_as_geojson(spark, tmp_path):
    import json

    f = RasterFrame.from_numpy(spark, np.array([[[1, 1, 1], [1, 0, 1], [1, 1, 1]]], float), GridMeta(0, 3, 1, 1, 3, 3), ["v"])
    reader.write_vector(f.to_polygons("v"), f"{tmp_path}/out.geojson")
    rows = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out.geojson").collect()]
    assert sorted(len(r["geometry"]["coordinates"]) for r in rows) == [1, 2] and all(len(p) == 2 for r in rows for ring in r["geometry"]["coordinates"] for p in ring)


def test_robust_line(spark):
    from rastermill.functions.radiometry import theil_sen

    rows = [(float(i), 2.0 * i + 1 + (500.0 if i % 5 == 0 else 0.0)) for i in range(300)]
    got = theil_sen(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert abs(got.m - 2) < 0.2 and abs(got.b) < 60


def test_catalog_composite(spark):
    manifest = spark.createDataFrame([("a", "hls_l30", "2022-01-01", 5.0), ("b", "hls_l30", "2022-01-20", 90.0), ("c", "other", "2022-01-05", 1.0)], "scene_id string, collection string, t string, cloud_cover double").withColumn("time", F.col("t").cast("timestamp"))
    read = lambda scenes: scenes.select("time", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(5000.0).alias("red"), F.lit(0).alias("qa"))
    got = reader.composite_catalog(manifest, read, ["red"], "hls_l30", "qa", "MS", max_cloud=50).collect()
    assert [(str(r.time)[:10], r.red) for r in got] == [("2022-01-01", 0.5)]


def test_open_warps_other_phases_and_systems(spark, tmp_path):
    """Images of one phase are renumbered, others take the value under each cell's centre; compared with plain loops over the cells."""
    import math

    from rastermill.config import configured
    from rastermill.grid import lonlat_to_xy, xy_to_lonlat

    grids = {"a": GRID, "b": GRID.replace(left=600043.0, top=3999991.0, cellx=20.0, celly=20.0), "c": GRID.in_crs(4326), "d": GRID.in_crs(32620)}
    data = {k: np.random.default_rng(i).random((g.nrows, g.ncols)) for i, (k, g) in enumerate(grids.items())}
    for k, g in grids.items():
        RasterFrame.from_numpy(spark, data[k][None], g, ["v"]).save(f"{tmp_path}/{k}")

    def under(k, goal):
        out, g = np.full((goal.nrows, goal.ncols), np.nan), grids[k]
        for r in range(goal.nrows):
            for c in range(goal.ncols):
                x, y = goal.left + (c + 0.5) * goal.cellx, goal.top - (r + 0.5) * goal.celly
                if g.crs != goal.crs:
                    x, y = lonlat_to_xy(*xy_to_lonlat(x, y, goal.crs, math), g.crs, math)
                i, j = math.floor((g.top - y) / g.celly), math.floor((x - g.left) / g.cellx)
                if 0 <= i < g.nrows and 0 <= j < g.ncols:
                    out[r, c] = data[k][i, j]
        return out

    both = RasterFrame.open(spark, [f"{tmp_path}/{k}" for k in grids], mosaic=True, overlap="max")
    want = np.nanmax(np.stack([under(k, GRID) for k in grids]), axis=0)
    assert both.grid.same_grid(GRID) and np.allclose(both.to_numpy()[0], want)
    stacked = RasterFrame.open(spark, [f"{tmp_path}/{k}" for k in ("a", "c")], stack_dim="band", bands=["one", "two"])
    seen = under("c", GRID)
    got = stacked.to_numpy()
    assert np.allclose(got[1][~np.isnan(got[1])], seen[~np.isnan(got[1])]) and np.isnan(got[1]).sum() == np.isnan(seen).sum()
    with configured(ref_crs=4326):
        warped = RasterFrame.open(spark, f"{tmp_path}/a")
    assert warped.grid.crs == 4326 and np.allclose(warped.to_numpy()[0], under("a", warped.grid), equal_nan=True)
    wide = RasterFrame.open(spark, [f"{tmp_path}/a", f"{tmp_path}/d"], mosaic=True, bounds_by="union")
    assert wide.grid.nrows >= GRID.nrows and wide.grid.ncols >= GRID.ncols
    assert np.allclose(RasterFrame.open(spark, f"{tmp_path}/a").transform_crs(4326).to_numpy(), warped.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("block", [None, 5, 8])
def test_geotiff_folder_of_blocks(spark, tmp_path, block):
    f = frame(spark)
    f.save(f"{tmp_path}/a.tif", block=block)
    again = RasterFrame.open(spark, f"{tmp_path}/a.tif", bands=f.bands)
    assert again.grid.same_grid(GRID) and np.allclose(again.to_numpy(), f.to_numpy())


def test_geotiff_folder_of_unlike_grids(spark, tmp_path):
    f = frame(spark)
    f.save(f"{tmp_path}/a.tif")
    RasterFrame(f.df, f.grid.replace(left=600013.0)).save(f"{tmp_path}/b.tif")
    with pytest.raises(ValueError):
        RasterFrame.open(spark, f"{tmp_path}/*.tif")
    assert RasterFrame.open(spark, [f"{tmp_path}/a.tif", f"{tmp_path}/b.tif"], mosaic=True).grid.same_grid(GRID)
