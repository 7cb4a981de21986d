"""Polygons and points against pixels: bucketed equi-joins on tile keys, ray casting in Catalyst.

A polygon row has an id and ring: array<struct<x,y>> (closed or not; the rule is even-odd).  Points have x and y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col
from ..grid import Bounds, GridMeta, col_of, row_of, x_of, y_of
from .shared import components

RING = "array<struct<x:double,y:double>>"


def polygons(spark, rows: list[tuple]) -> DataFrame:
    """(id, value, [(x, y), ...]) to rows id, value, ring."""
    return spark.createDataFrame([(i, float(v), [(float(x), float(y)) for x, y in ring]) for i, v, ring in rows], f"id long, value double, ring {RING}")


def _edges(ring: Column, test) -> Column:
    """test(x1, y1, x2, y2) of each edge."""
    return F.transform(ring, lambda p, i: test(p["x"], p["y"], F.get(ring, F.pmod(i + 1, F.size(ring)))["x"], F.get(ring, F.pmod(i + 1, F.size(ring)))["y"]))


def point_in_polygon(x, y, ring: Column) -> Column:
    """Even-odd rule: edges crossed by a ray to the right."""
    px, py = col(x), col(y)

    def crossed(x1, y1, x2, y2):
        at = x1 + (py - y1) * F.try_divide(x2 - x1, y2 - y1)
        return ((y1 > py) != (y2 > py)) & F.coalesce(px < at, F.lit(False))

    return F.aggregate(_edges(ring, crossed), F.lit(False), lambda odd, hit: odd != hit)


def edge_in_cell(x0: Column, y0: Column, x1: Column, y1: Column, ring: Column) -> Column:
    """Whether any edge meets the box: the edge's parameter range is cut by the box's two slabs."""

    def slab(a, b, low, high):
        t, u = F.try_divide(low - a, b - a), F.try_divide(high - a, b - a)
        inside = (a >= low) & (a <= high)
        return F.coalesce(F.least(t, u), F.when(inside, -1.0).otherwise(2.0)), F.coalesce(F.greatest(t, u), F.when(inside, 2.0).otherwise(-1.0))

    def meets(ax, ay, bx, by):
        tx, ux = slab(ax, bx, x0, x1)
        ty, uy = slab(ay, by, y0, y1)
        return F.greatest(tx, ty, F.lit(0.0)) <= F.least(ux, uy, F.lit(1.0))

    return F.exists(_edges(ring, meets), lambda hit: hit)


def _box(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def _tiles(shapes: DataFrame, grid: GridMeta, tile: int) -> DataFrame:
    """The polygons that meet the grid, once for each tile that their box meets: __trow, __tcol."""
    left, bottom, right, top = _box(F.col("ring"))
    span = lambda a, b, n: F.sequence(F.greatest(F.lit(0), F.floor(a / tile).cast("int")), F.least(F.lit((n - 1) // tile), F.floor(b / tile).cast("int")))
    meets = (top > grid.bounds.bottom) & (bottom < grid.bounds.top) & (right > grid.bounds.left) & (left < grid.bounds.right)
    return shapes.filter(meets).withColumn("__trow", F.explode(span(row_of(grid, top), row_of(grid, bottom), grid.nrows))).withColumn("__tcol", F.explode(span(col_of(grid, left), col_of(grid, right), grid.ncols)))


def cells_of(shapes: DataFrame, grid: GridMeta, all_touched: bool = False, tile: int = 64) -> DataFrame:
    """id, value, row, col of the grid's cells in each polygon (centre inside; or touched at all).

    The tiles that a polygon's box meets are dealt over the tasks before their cells are listed, so a large polygon isn't one task.
    """
    left, bottom, right, top = _box(F.col("ring"))
    within = lambda t, n, a, b: F.sequence(F.greatest(F.col(t) * tile, a), F.least(F.col(t) * tile + (tile - 1), F.lit(n - 1), b))
    dealt = _tiles(shapes, grid, tile).repartition("__trow", "__tcol")
    cells = dealt.withColumn("row", F.explode(within("__trow", grid.nrows, row_of(grid, top), row_of(grid, bottom)))).withColumn("col", F.explode(within("__tcol", grid.ncols, col_of(grid, left), col_of(grid, right))))
    return cells.filter(_covers(grid, all_touched)).drop("ring", "__trow", "__tcol")


def _covers(grid: GridMeta, all_touched: bool) -> Column:
    inside = point_in_polygon(x_of(grid), y_of(grid), F.col("ring"))
    if not all_touched:
        return inside
    x, y = x_of(grid), y_of(grid)
    return inside | edge_in_cell(x - grid.cellx / 2, y - grid.celly / 2, x + grid.cellx / 2, y + grid.celly / 2, F.col("ring"))


def covered(pixels: DataFrame, shapes: DataFrame, grid: GridMeta, all_touched: bool = False, tile: int = 64) -> DataFrame:
    """Pixels joined to the polygons that cover them: an equi-join on tile keys, then the exact test."""
    dealt = _tiles(shapes, grid, tile)
    keyed = pixels.withColumns({"__trow": F.floor(F.col("row") / tile).cast("int"), "__tcol": F.floor(F.col("col") / tile).cast("int")})
    return keyed.join(dealt, ["__trow", "__tcol"]).filter(_covers(grid, all_touched)).drop("__trow", "__tcol", "ring")


def mask(pixels: DataFrame, bands: list[str], shapes: DataFrame, grid: GridMeta, keep: str = "in", all_touched: bool = True) -> DataFrame:
    """Bands NULL outside (keep="in") or inside (keep="out") the polygons."""
    inside = cells_of(shapes, grid, all_touched).select("row", "col").distinct().withColumn("__in", F.lit(True))
    flag = F.col("__in").isNotNull() if keep == "in" else F.col("__in").isNull()
    return pixels.join(inside, ["row", "col"], "left").withColumns({b: F.when(flag, F.col(b)) for b in bands}).drop("__in")


def clip(pixels: DataFrame, bands: list[str], bounds: Bounds, grid: GridMeta, shapes: DataFrame | None = None, expand_by: int = 0) -> tuple[DataFrame, GridMeta]:
    """Window of bounds (and expand_by cells around), renumbered; with shapes also masked."""
    r, c, h, w = grid.window_of(bounds)
    r0, c0, r1, c1 = max(0, r - expand_by), max(0, c - expand_by), min(grid.nrows, r + h + expand_by), min(grid.ncols, c + w + expand_by)
    inner = pixels.filter(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
    inner = mask(inner, bands, shapes, grid, "in", False) if shapes is not None else inner
    return inner.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0}), grid.at_window(r0, c0, r1 - r0, c1 - c0)


def subset(pixels: DataFrame, grid: GridMeta, row: int, col_: int, height: int, width: int, circle: bool = False) -> tuple[DataFrame, GridMeta]:
    """A window; circle: only cells whose centre is in the disk inscribed in it."""
    out = pixels.filter(F.col("row").between(row, row + height - 1) & F.col("col").between(col_, col_ + width - 1))
    if circle:
        dy, dx = F.col("row") + 0.5 - (row + height / 2), F.col("col") + 0.5 - (col_ + width / 2)
        out = out.filter(dy * dy + dx * dx <= (min(height, width) / 2) ** 2)
    return out.withColumns({"row": F.col("row") - row, "col": F.col("col") - col_}), grid.at_window(row, col_, height, width)


def rasterize(spark, shapes: DataFrame, grid: GridMeta, all_touched: bool = True, fill: float = 0.0) -> DataFrame:
    """row, col, value of every cell; where polygons overlap the one of the greatest id wins."""
    burnt = cells_of(shapes, grid, all_touched).groupBy("row", "col").agg(F.max_by("value", "id").alias("value"))
    cells = spark.range(grid.nrows * grid.ncols).select(F.floor(F.col("id") / grid.ncols).cast("int").alias("row"), (F.col("id") % grid.ncols).cast("int").alias("col"))
    return cells.join(burnt, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(float(fill))))


def recode(pixels: DataFrame, band: str, shapes: DataFrame, grid: GridMeta, to_replace: dict) -> DataFrame:
    """Values mapped inside polygons only; "mode" stands for the most frequent value inside (the least of equals)."""
    inside = cells_of(shapes, grid, False).select("row", "col").distinct().withColumn("__in", F.lit(True))
    held = pixels.join(inside, ["row", "col"], "left")
    if "mode" in to_replace.values():
        counts = held.filter("__in").filter(F.col(band).isNotNull()).groupBy(band).count()
        mode = counts.agg(F.max_by(F.col(band), F.struct("count", -F.col(band))).alias("__mode"))
        held = held.crossJoin(F.broadcast(mode))  # one row
    out = F.col(band)
    for k, v in to_replace.items():
        out = F.when(F.col("__in") & (F.col(band) == k), F.col("__mode") if v == "mode" else F.lit(v).cast(pixels.schema[band].dataType)).otherwise(out)
    return held.withColumn(band, out).select(*pixels.columns)


def extract_points(pixels: DataFrame, bands: list[str], points: DataFrame, grid: GridMeta) -> DataFrame:
    """The points' columns and the bands of the pixel under each; points outside have no row."""
    placed = points.withColumns({"row": row_of(grid, F.col("y")), "col": col_of(grid, F.col("x"))})
    keys = ["time"] if "time" in pixels.columns else []
    return placed.join(pixels.select(*keys, "row", "col", *bands), ["row", "col"])


def extract_wide(pixels: DataFrame, bands: list[str], places: DataFrame, grid: GridMeta, all_touched: bool = False, times: list | None = None) -> DataFrame:
    """A row for each point, or for each pixel that a polygon covers, with columns t1_<band>, t2_<band>, ... by ascending time.

    times: the slices wanted; without it the cube's distinct ones, a value each on the driver.  Missing values and slices that lack the
    pixel are NULL; places outside have no row; equal rows of places are one.
    """
    found = covered(pixels, places, grid, all_touched) if "ring" in places.columns else extract_points(pixels, bands, places, grid)
    listed = sorted(times if times is not None else [r[0] for r in pixels.select("time").distinct().collect()])
    keys = [c for c in places.columns if c != "ring"]
    at = lambda t, b: F.max(F.when(F.col("time") == F.lit(t).cast(pixels.schema["time"].dataType), F.col(b)))
    return found.groupBy(*keys, "row", "col").agg(*[at(t, b).alias(f"t{i}_{b}") for i, t in enumerate(listed, 1) for b in bands])


def polygon_points(shapes: DataFrame, res: tuple[float, float], frac: float = 1.0, min_points: int | None = None, seed: int = 1) -> DataFrame:
    """Cell centres inside each polygon on a grid from its own top left corner; frac of them, unless there are few."""
    left, bottom, right, top = _box(F.col("ring"))
    rx, ry = res
    cells = shapes.withColumn("__i", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((top - bottom) / ry).cast("int") - 1, F.lit(0))))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((right - left) / rx).cast("int") - 1, F.lit(0)))))
    centres = cells.withColumns({"x": left + (F.col("__j") + 0.5) * rx, "y": top - (F.col("__i") + 0.5) * ry})
    inside = centres.filter(point_in_polygon("x", "y", F.col("ring")))
    if frac < 1:
        w = Window.partitionBy("id")
        rank = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "id", "__i", "__j")))
        few = F.count(F.lit(1)).over(w) <= (min_points or 0)
        inside = inside.withColumn("__keep", few | (rank <= F.round(frac * F.count(F.lit(1)).over(w)))).filter("__keep").drop("__keep")
    return inside.drop("__i", "__j", "ring")


def zonal(pixels: DataFrame, bands: list[str], shapes: DataFrame, grid: GridMeta) -> DataFrame:
    """id, n, and mean, min, max of each band by polygon."""
    aggs = [f(b).alias(f"{b}_{n}") for b in bands for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return covered(pixels, shapes, grid).groupBy("id").agg(F.count(F.lit(1)).alias("n"), *aggs)


def remove_near_points(points: DataFrame, radius: float) -> DataFrame:
    """Of each pair of points (id, x, y) no further apart than radius the lesser id goes: a self-join on grid buckets."""
    cell = lambda c: F.floor(F.col(c) / radius)
    one = points.select("id", "x", "y", cell("x").alias("bx"), cell("y").alias("by"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = one.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "bx", "by", F.inline(around)).select("id2", "x2", "y2", (F.col("bx") + F.col("i")).alias("bx"), (F.col("by") + F.col("j")).alias("by"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    near = one.join(spread, ["bx", "by"]).filter((F.col("id") < F.col("id2")) & (dx * dx + dy * dy <= radius * radius)).select("id").distinct()
    return points.join(near, "id", "left_anti")


def regions(pixels: DataFrame, band: str, connectivity: int = 4, tile: int = 256) -> DataFrame:
    """row, col, value, region: connected cells of equal value share the least cell number of theirs.  NULL cells have no row.

    Each tile is labelled by itself (a task holds tile x tile cells); only the labels that meet across tiles are joined as a graph, in
    rounds that are written and read again.
    """
    cells = pixels.filter(F.col(band).isNotNull()).select("row", "col", F.col(band).alias("value"))
    kind = cells.schema["value"].dataType.simpleString()
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])

    def label(key, rows):
        import numpy as np
        import pandas as pd

        r, c = rows["row"].to_numpy(np.int64), rows["col"].to_numpy(np.int64)
        number = (r << 31) + c
        code = pd.factorize(rows["value"], use_na_sentinel=False)[0]
        box = np.full((tile + 1, tile + 2), -1)
        box[r % tile, c % tile + 1] = np.arange(len(rows))
        pairs = []
        for dr, dc in steps:
            a, b = box[:tile, 1:-1], box[dr : dr + tile, 1 + dc : 1 + dc + tile]
            near = (a >= 0) & (b >= 0)
            a, b = a[near], b[near]
            pairs.append(np.stack([a, b])[:, code[a] == code[b]])
        a, b = np.concatenate(pairs, 1)
        order = np.argsort(number)  # the place in this order stands for the cell, so that least places are least numbers
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        head, a, b = np.arange(len(rows)), place[a], place[b]
        while (head[a] != head[b]).any():
            x, y = head[a], head[b]
            np.minimum.at(head, np.maximum(x, y), np.minimum(x, y))
            while (head != head[head]).any():
                head = head[head]
        return rows[["row", "col", "value"]].assign(region=number[order][head[place]])

    dealt = cells.groupBy(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    marked = _held(dealt.applyInPandas(label, f"row int, col int, value {kind}, region long"))
    last = lambda c: F.pmod(F.col(c), F.lit(tile)) == tile - 1
    near = F.inline(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps]))
    rim = marked.filter(last("row") | last("col") | (F.pmod(F.col("col"), F.lit(tile)) == 0)).select(F.col("region").alias("a"), "row", "col", "value", near)
    moved = rim.select("a", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "value")
    links = moved.join(marked.withColumnRenamed("region", "b"), ["row", "col", "value"]).filter("a <> b").select("a", "b").distinct()
    heads = components(links)
    return marked.join(heads, marked.region == heads.node, "left").select("row", "col", "value", F.coalesce("head", "region").alias("region"))


def _held(df: DataFrame) -> DataFrame:
    from .shared import cut_lineage

    return cut_lineage(df)


def polygonize(pixels: DataFrame, band: str, grid: GridMeta, connectivity: int = 4) -> DataFrame:
    """region, value, cells, area and wkt of each connected region.

    Cell sides between a region and anything else are its boundary; each region's boundary (not its cells) is traced in one task.
    """
    marked = _held(regions(pixels, band, connectivity))
    sides = [(-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0)]  # neighbour, then the side from one corner to the next, clockwise
    near = F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "r0", "c0", "r1", "c1"), s, strict=True)]) for s in sides]))
    out = marked.select("row", "col", "value", "region", near).select("value", "region", (F.col("row") + F.col("dr")).alias("nrow"), (F.col("col") + F.col("dc")).alias("ncol"), (F.col("row") + F.col("r0")).alias("r0"), (F.col("col") + F.col("c0")).alias("c0"), (F.col("row") + F.col("r1")).alias("r1"), (F.col("col") + F.col("c1")).alias("c1"))
    other = marked.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("region").alias("other"))
    border = out.join(other, ["nrow", "ncol"], "left").filter(F.col("other").isNull() | (F.col("other") != F.col("region"))).select("region", "r0", "c0", "r1", "c1")
    left, top, cx, cy = grid.left, grid.top, grid.cellx, grid.celly

    def trace(key, rows):
        import pandas as pd

        follow: dict = {}
        for r0, c0, r1, c1 in rows[["r0", "c0", "r1", "c1"]].sort_values(["r0", "c0", "r1", "c1"]).itertuples(index=False):
            follow.setdefault((r0, c0), []).append((r1, c1))
        rings = []
        while follow:
            at = begin = min(follow)
            ring, came = [at], None
            while True:
                ways = follow[at]
                # where two corners meet turn right first, so that rings do not cross themselves
                turn = lambda b: 0 if came is None else {(came[1], -came[0]): 0, came: 1, (-came[1], came[0]): 2}.get((b[0] - at[0], b[1] - at[1]), 3)  # noqa: B023, E731
                to = min(ways, key=turn)
                ways.remove(to)
                if not ways:
                    del follow[at]
                came, at = (to[0] - at[0], to[1] - at[1]), to
                if at == begin:
                    break
                ring.append(at)
            corners = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0], p[1] - ring[i - 1][1]) != (ring[(i + 1) % len(ring)][0] - p[0], ring[(i + 1) % len(ring)][1] - p[1])]
            rings.append(corners + corners[:1])
        rings.sort(key=lambda r: -len(r))
        size = lambda r: sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(r, r[1:], strict=False))
        rings.sort(key=lambda r: -abs(size(r)))
        text = ", ".join("(" + ", ".join(f"{left + c * cx:.10g} {top - r * cy:.10g}" for r, c in ring) + ")" for ring in rings)
        return pd.DataFrame({"region": [key[0]], "wkt": [f"POLYGON ({text})"]})

    shapes = border.groupBy("region").applyInPandas(trace, "region long, wkt string")
    sizes = marked.groupBy("region").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("cells"))
    return sizes.join(shapes, "region").withColumn("area", F.col("cells") * grid.cell_area)
