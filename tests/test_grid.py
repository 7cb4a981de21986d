import math

import pytest

from rastermill import sensors
from rastermill.config import configured, current
from rastermill.grid import Bounds, GridMeta, align_bounds, array_megabytes, check_chunksize, common_bounds, lonlat_to_xy, parse_crs, parse_res, project_bounds, window_offsets, xy_to_lonlat


def test_align_bounds_snaps_outward():
    b, width, height = align_bounds(-100, -100, 100, 100, 1.67)
    assert b.left == -100.19999999999999 and b.top == 100.19999999999999 and width == height == 120


def test_shape_is_rounded_not_cut():
    grid = GridMeta.from_bounds((0, 0, 2560 - 1e-10, 2560), 10, 3857)
    assert (grid.nrows, grid.ncols) == (256, 256)


def test_coordinates_round_trip():
    g = GridMeta(600000.0, 4000000.0, 30.0, 20.0, 50, 60)
    assert g.to_indices(*[v + d for v, d in zip(g.to_coords(7, 9), (1, -1), strict=True)]) == (7, 9)
    assert g.window_of(g.bounds) == (0, 0, 50, 60)
    assert g.at_window(5, 6, 10, 12).bounds == Bounds(600180.0, 3999700.0, 600540.0, 3999900.0)
    assert GridMeta.from_json(g.replace(bands=("a", "b")).json()) == g.replace(bands=("a", "b"))


def test_crs_and_resolution():
    assert parse_crs("EPSG:32621") == parse_crs(32621) == parse_crs("+proj=utm +zone=21 +datum=WGS84") == parse_crs({"init": "epsg:32621"})
    assert parse_crs("+proj=utm +zone=21 +south") == 32721 and parse_crs("+proj=longlat +datum=WGS84") == 4326
    for bad, error in (("nonsense", ValueError), (1.5, TypeError), (None, TypeError)):
        with pytest.raises(error):
            parse_crs(bad)
    assert parse_res(3) == (3.0, 3.0) and parse_res((1, 2)) == (1.0, 2.0)
    with pytest.raises(TypeError):
        parse_res("3")


@pytest.mark.parametrize("crs,lon,lat,x,y", [(32631, 3.0, 0.0, 500000.0, 0.0), (32721, -57.0, 0.0, 500000.0, 10000000.0), (3857, 180.0, 0.0, 20037508.342789244, 0.0)])
def test_projection_of_known_points(crs, lon, lat, x, y):
    got = lonlat_to_xy(lon, lat, crs, math)
    assert got == pytest.approx((x, y), abs=1e-3)


@pytest.mark.parametrize("crs", [32621, 32721, 3857, 4326])
def test_projection_round_trip(crs):
    for lon, lat in ((-57.5, -25.3), (-55.1, 12.2), (-59.9, 61.0)):
        assert xy_to_lonlat(*lonlat_to_xy(lon, lat, crs, math), crs, math) == pytest.approx((lon, lat), abs=1e-8)


def test_projected_bounds_hold_their_corners():
    b = project_bounds((-58, -26, -57, -25), 32721)
    x, y = lonlat_to_xy(-57.5, -25.5, 32721, math)
    assert b.left < x < b.right and b.bottom < y < b.top and b.right - b.left > 90_000


def test_windows():
    assert window_offsets(5, 4, 3, 3) == [(0, 0, 3, 3), (0, 3, 3, 1), (3, 0, 2, 3), (3, 3, 2, 1)]
    assert window_offsets(6, 6, 3, 3, (1, 1, 1, 1))[3] == ((3, 3, 3, 3), (2, 2, 4, 4))
    assert [check_chunksize(a, b) for a, b in ((0, 4000), (100, 4000), (512, 100), (5, 5))] == [512, 96, 64, 16]
    assert array_megabytes(2, 3, 100, 100, "float64") == 0.48


def test_boxes():
    a, b = Bounds(0, 0, 10, 10), Bounds(2, 2, 4, 4)
    assert a.relate(b, "contains") and b.relate(a, "within") and a.relate(Bounds(10, 0, 20, 10), "touches") and a.relate(Bounds(11, 0, 12, 1), "disjoint")
    assert Bounds.parse("BoundingBox(left=1.0, bottom=-2.0, right=3.0, top=4.5)") == Bounds(1, -2, 3, 4.5)
    g = [GridMeta(0, 10, 1, 1, 10, 10), GridMeta(5, 12, 1, 1, 10, 10)]
    assert common_bounds(g, "union") == Bounds(0, 0, 15, 12) and common_bounds(g, "intersection") == Bounds(5, 2, 10, 10) and common_bounds(g) == g[0].bounds
    with pytest.raises(ValueError):
        common_bounds([g[0], GridMeta(50, 10, 1, 1, 5, 5)], "intersection")


def test_settings_win_and_come_back():
    with configured(nodata=7, sensor="l7", ref_res=60.0) as c:
        assert c.value("nodata", 1, 2) == 7 and current().value("scale_factor", 3, 4) == 3
        assert c.band_names(None, None, 6)[0] == "blue" and c.band_names(["x"], None, 1) == ("x",)
        assert c.resolve_grid(GridMeta(0, 600, 30, 30, 20, 20)).res == (60.0, 60.0)
    assert current().nodata is None and current().value("nodata", None, 2) == 2


def test_sensors():
    assert sensors.SENSORS["l8"][0] == "coastal" and sensors.SENSORS["s2al7"] == sensors.SENSORS["l7"] and len(sensors.SENSORS["s2af"]) == 13
    assert sensors.wavelengths("s2a20")["rededge"] == 0.8647 and sensors.wavelengths("l8l7mspan")["pan"] == 0.59
    assert sensors.hls_band("nir", "hls_s30") == "B8A" and sensors.hls_band("nir", "HLSL30") == "B05" and sensors.hls_band("odd", "hls_l30") == "odd"
    assert all(len(m) <= len(sensors.SENSORS[s if s != "l8" else "l8l7"]) for s, m in sensors.TASSELED_CAP.items())


def test_crs_of_wkt_and_grids_in_another_crs():
    wkt = 'PROJCS["WGS 84 / UTM zone 21N",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32621"]]'
    assert parse_crs(wkt) == 32621 and parse_crs('PROJCRS["x",BASEGEOGCRS["WGS 84",ID["EPSG",4326]],ID["EPSG",32721]]') == 32721
    assert parse_crs('PROJCS["WGS_1984_UTM_Zone_21S",GEOGCS["GCS_WGS_1984"]]'.replace("1984_UTM", "1984 / UTM")) == 32721
    own = GridMeta(600000.0, 4000000.0, 30.0, 30.0, 40, 25, 32621)
    there = own.in_crs(4326)
    lon, lat = xy_to_lonlat(600375.0, 3999400.0, 32621, math)
    b = there.bounds
    assert there.crs == 4326 and b.left < lon < b.right and b.bottom < lat < b.top
    assert abs(math.hypot(there.nrows, there.ncols) - math.hypot(40, 25)) < 2 and own.in_crs(32621) is own
    assert own.same_phase(own.replace(left=600300.0)) and not own.same_phase(own.replace(left=600301.0)) and not own.same_phase(there)
