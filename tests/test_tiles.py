"""Regions, slopes and weighted windows against plain loops."""

import math
import random

import pytest

from rastermill.operators import focal, vector


@pytest.mark.parametrize("connectivity", [4, 8])
def test_regions_do_not_depend_on_tiles(spark, connectivity):
    r = random.Random(connectivity)
    cells = {(y, x): r.randrange(2) for y in range(13) for x in range(11) if r.random() < 0.95}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    want, left = {}, dict(cells)
    for start in sorted(cells):
        todo = [start] if start in left else []
        while todo:
            at = todo.pop()
            if left.pop(at, None) is not None:
                want[at] = (start[0] << 31) + start[1]
                todo += [n for dy, dx in steps if (n := (at[0] + dy, at[1] + dx)) in left and cells[n] == cells[at]]
    df = spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], "row int, col int, v int")
    got = {(g.row, g.col): g.region for g in vector.regions(df, "v", connectivity, tile=4).collect()}
    assert got == want


def test_slopes_over_gaps_are_missing(spark):
    cells = {(y, x): 2.0 * x for y in range(3) for x in (0, 1, 2, 5, 6, 7)}
    df = spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], "row int, col int, elev double")
    got = {(g.row, g.col): g.slope for g in focal.slope_aspect(df, "elev", 3, 8, 1.0, 1.0, tile=2).collect()}
    assert len(got) == len(cells)
    for (y, x), slope in got.items():
        rise = {0: 1.0, 1: 2.0, 6: 2.0, 7: 1.0}.get(x)  # 2 and 5 stand beside the gap
        assert slope is None if rise is None else abs(slope - math.degrees(math.atan(rise))) < 1e-9


@pytest.mark.parametrize("stat", ["var", "std", "expand"])
def test_weighted_windows(spark, stat):
    r = random.Random(1)
    cells = {(y, x): float(r.randrange(3)) if r.random() < 0.9 else None for y in range(6) for x in range(7)}
    df = spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], "row int, col int, v double")
    got = {(g.row, g.col): g.v for g in focal.moving(df, "v", 6, 7, stat, 5, weights=True).collect()}
    mirror = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    for (y, x), here in cells.items():
        near = [(1 - math.hypot(dy, dx) / math.hypot(2, 2), cells[mirror(y + dy, 6), mirror(x + dx, 7)]) for dy in range(-2, 3) for dx in range(-2, 3)]
        near = [(w, v) for w, v in near if v is not None]
        if stat == "expand":
            want = 1.0 if here == 0 and any(w > 1e-12 and v == 1 for w, v in near) else here
        else:
            total = sum(w for w, _ in near)
            mean = sum(w * v for w, v in near) / total
            want = sum((w * v - mean) ** 2 for w, v in near) / total
            want = math.sqrt(want) if stat == "std" else want
        assert got[y, x] == want or abs(got[y, x] - want) < 1e-9
