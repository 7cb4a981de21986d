"""Grid description, coordinates and windows: driver-side arithmetic on small immutable values."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import functions as F

#: Semi-major axis and flattening of WGS 84.
A, FLAT = 6378137.0, 1 / 298.257223563
ITEM_BYTES = {"uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4, "float32": 4, "uint64": 8, "int64": 8, "float64": 8}


def parse_crs(crs) -> int:
    """EPSG number of an int, "EPSG:n", "n", a dict with init/epsg, a PROJ string of UTM, Web Mercator or lon/lat, or WKT (its last
    EPSG identifier is the whole system's; without one, a name of a UTM zone on WGS 84)."""
    if isinstance(crs, bool) or not isinstance(crs, (int, str, dict)):
        raise TypeError(f"a CRS is an int, str or dict, not {type(crs).__name__}")
    if isinstance(crs, dict):
        return parse_crs(crs.get("init", crs.get("epsg", "")) or " ".join(f"+{k}={v}" for k, v in crs.items()))
    if isinstance(crs, int):
        return crs
    if m := re.fullmatch(r"(?:(?i:epsg):)?(\d{4,6})", crs.strip()):
        return int(m[1])
    if codes := re.findall(r"(?i)\b(?:AUTHORITY|ID)\s*\[\s*\"EPSG\"\s*,\s*\"?(\d+)", crs):
        return int(codes[-1])
    if m := re.search(r"(?i)WGS[ _]?(?:19)?84\s*/\s*UTM[ _]zone[ _](\d+)([NS])", crs.replace("_", " ")):
        return (32700 if m[2].upper() == "S" else 32600) + int(m[1])
    if "+proj=utm" in crs and (m := re.search(r"\+zone=(\d+)", crs)):
        return (32700 if "+south" in crs else 32600) + int(m[1])
    if "+proj=merc" in crs and "6378137" in crs:
        return 3857
    if re.search(r"\+proj=(longlat|latlong)", crs):
        return 4326
    raise ValueError(f"unknown CRS {crs!r}")


def parse_res(res) -> tuple[float, float]:
    if isinstance(res, (int, float)) and not isinstance(res, bool):
        return float(res), float(res)
    if isinstance(res, (tuple, list)) and len(res) == 2:
        return float(res[0]), float(res[1])
    raise TypeError("a resolution is a number or a pair of numbers")


def is_geographic(crs: int) -> bool:
    return 4000 <= crs < 5000


@dataclass(frozen=True)
class Bounds:
    left: float
    bottom: float
    right: float
    top: float

    @classmethod
    def parse(cls, given) -> Bounds:
        """Bounds, a 4-tuple, or text such as "BoundingBox(left=..., bottom=..., right=..., top=...)"."""
        if isinstance(given, Bounds):
            return given
        if isinstance(given, str):
            named = dict(re.findall(r"(left|bottom|right|top)\s*=\s*(-?[\d.eE+-]+)", given))
            if len(named) == 4:
                return cls(**{k: float(v) for k, v in named.items()})
            given = re.findall(r"-?\d[\d.eE+-]*", given)
        if len(given) != 4:
            raise ValueError("bounds have four numbers")
        return cls(*map(float, given))

    def union(self, other: Bounds) -> Bounds:
        return Bounds(min(self.left, other.left), min(self.bottom, other.bottom), max(self.right, other.right), max(self.top, other.top))

    def intersection(self, other: Bounds) -> Bounds:
        return Bounds(max(self.left, other.left), max(self.bottom, other.bottom), min(self.right, other.right), min(self.top, other.top))

    def relate(self, other: Bounds, how: str = "intersects") -> bool:
        """intersects, disjoint, contains, within, equals, touches, overlaps between two boxes."""
        meet = self.left <= other.right and other.left <= self.right and self.bottom <= other.top and other.bottom <= self.top
        inner = self.left < other.right and other.left < self.right and self.bottom < other.top and other.bottom < self.top
        holds = self.left <= other.left and self.bottom <= other.bottom and self.right >= other.right and self.top >= other.top
        held = other.left <= self.left and other.bottom <= self.bottom and other.right >= self.right and other.top >= self.top
        return {"intersects": meet, "disjoint": not meet, "contains": holds, "within": held, "equals": holds and held, "touches": meet and not inner, "overlaps": inner and not holds and not held}[how]


def align_bounds(minx, miny, maxx, maxy, res) -> tuple[Bounds, int, int]:
    """Bounds snapped outward to multiples of the resolution, width and height."""
    xres, yres = parse_res(res)
    out = Bounds(math.floor(minx / xres) * xres, math.floor(miny / yres) * yres, math.ceil(maxx / xres) * xres, math.ceil(maxy / yres) * yres)
    return out, round((out.right - out.left) / xres), round((out.top - out.bottom) / yres)


def check_chunksize(size: int, most: int) -> int:
    """Nearest multiple of 16 (512 when not positive), halved while larger than the array, at least 16."""
    near = lambda x: max(16, int(round(x / 16.0)) * 16)
    size = near(512 if size <= 0 else size)
    while size > most and size > 16:
        size = near(size // 2)
    return size


def window_offsets(nrows: int, ncols: int, row_chunks: int, col_chunks: int, padding=None) -> list:
    """Row-major windows (row_off, col_off, height, width); with padding (left, bottom, right, top) pairs with the padded window."""
    out = []
    for r in range(0, nrows, row_chunks):
        for c in range(0, ncols, col_chunks):
            w = (r, c, min(row_chunks, nrows - r), min(col_chunks, ncols - c))
            if padding:
                left, bottom, right, top = padding
                r0, c0 = max(0, r - top), max(0, c - left)
                out.append((w, (r0, c0, min(nrows, w[0] + w[2] + bottom) - r0, min(ncols, w[1] + w[3] + right) - c0)))
            else:
                out.append(w)
    return out


def array_megabytes(ntime: int, nbands: int, nrows: int, ncols: int, dtype: str) -> float:
    return ntime * nbands * nrows * ncols * ITEM_BYTES[dtype] * 1e-6


@dataclass(frozen=True)
class GridMeta:
    """Where a raster lies: top left corner, cell sizes, shape, CRS, bands, missing-value rule, tile side, provenance."""

    left: float
    top: float
    cellx: float
    celly: float
    nrows: int
    ncols: int
    crs: int = 32621
    bands: tuple[str, ...] = ()
    nodata: float | None = None
    dtype: str = "float64"
    sensor: str | None = None
    scale: float = 1.0
    offset: float = 0.0
    tile: int = 512
    sources: tuple[str, ...] = field(default=())

    @property
    def bounds(self) -> Bounds:
        return Bounds(self.left, self.top - self.nrows * self.celly, self.left + self.ncols * self.cellx, self.top)

    @property
    def transform(self) -> tuple:
        return (self.cellx, 0.0, self.left, 0.0, -self.celly, self.top)

    @property
    def res(self) -> tuple[float, float]:
        return self.cellx, self.celly

    @property
    def cell_area(self) -> float:
        return abs(self.cellx * self.celly)

    def replace(self, **changes) -> GridMeta:
        return replace(self, **changes)

    def same_phase(self, other: GridMeta) -> bool:
        """One CRS and cell size, and cell edges that fall on each other: only whole cells lie between the two."""
        if self.crs != other.crs or not all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(self.res, other.res, strict=True)):
            return False
        apart = (self.left - other.left) / self.cellx, (self.top - other.top) / self.celly
        return all(abs(v - round(v)) < 1e-6 for v in apart)

    def same_grid(self, other: GridMeta) -> bool:
        return self.crs == other.crs and (self.nrows, self.ncols) == (other.nrows, other.ncols) and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(self.transform, other.transform, strict=True))

    @classmethod
    def from_bounds(cls, bounds, res, crs=32621, aligned: bool = False, **more) -> GridMeta:
        """Shape by rounding (a bound that misses a cell edge by a rounding error adds no cell)."""
        b, (xres, yres) = Bounds.parse(bounds), parse_res(res)
        if aligned:
            b = align_bounds(b.left, b.bottom, b.right, b.top, res)[0]
        return cls(b.left, b.top, xres, yres, max(1, round((b.top - b.bottom) / yres)), max(1, round((b.right - b.left) / xres)), parse_crs(crs), **more)

    def in_crs(self, crs: int, res=None) -> GridMeta:
        """The grid that covers this one in another CRS; without a resolution its square cells are as many along the diagonal."""
        if crs == self.crs and res is None:
            return self
        b = bounds_in(self, crs)
        cell = res or math.hypot(b.right - b.left, b.top - b.bottom) / math.hypot(self.nrows, self.ncols)
        made = GridMeta.from_bounds(b, cell, crs)
        return self.replace(left=made.left, top=made.top, cellx=made.cellx, celly=made.celly, nrows=made.nrows, ncols=made.ncols, crs=crs)

    def window_of(self, bounds) -> tuple[int, int, int, int]:
        """(row_off, col_off, height, width) of bounds, cut at the image."""
        b = Bounds.parse(bounds)
        c0, c1 = (min(max(round((x - self.left) / self.cellx), 0), self.ncols) for x in (b.left, b.right))
        r0, r1 = (min(max(round((self.top - y) / self.celly), 0), self.nrows) for y in (b.top, b.bottom))
        return r0, c0, r1 - r0, c1 - c0

    def at_window(self, row_off: int, col_off: int, height: int, width: int) -> GridMeta:
        return self.replace(left=self.left + col_off * self.cellx, top=self.top - row_off * self.celly, nrows=height, ncols=width)

    def to_indices(self, x: float, y: float) -> tuple[int, int]:
        """(row, col), cut towards zero."""
        return math.trunc((self.top - y) / self.celly), math.trunc((x - self.left) / self.cellx)

    def to_coords(self, row: float, col: float) -> tuple[float, float]:
        """(x, y) of the top left corner of a cell."""
        return self.left + col * self.cellx, self.top - row * self.celly

    def json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> GridMeta:
        got = json.loads(text)
        return cls(**got | {"bands": tuple(got["bands"]), "sources": tuple(got["sources"])})


def x_of(grid: GridMeta, col="col"):
    """Centre coordinate as a column."""
    return F.lit(grid.left) + (F.col(col) + 0.5) * grid.cellx


def y_of(grid: GridMeta, row="row"):
    return F.lit(grid.top) - (F.col(row) + 0.5) * grid.celly


def row_of(grid: GridMeta, y):
    return F.floor((F.lit(grid.top) - y) / grid.celly).cast("int")


def col_of(grid: GridMeta, x):
    return F.floor((x - F.lit(grid.left)) / grid.cellx).cast("int")


def chunk_grid(spark, grid: GridMeta):
    """chunk (from 1, row-major), left, bottom, right, top of each tile."""
    rows = spark.range(-(-grid.nrows // grid.tile)).withColumnRenamed("id", "trow")
    both = rows.select("trow", F.explode(F.sequence(F.lit(0), F.lit(-(-grid.ncols // grid.tile) - 1))).alias("tcol"))
    step_x, step_y, b = grid.tile * grid.cellx, grid.tile * grid.celly, grid.bounds
    number = F.col("trow") * -(-grid.ncols // grid.tile) + F.col("tcol") + 1
    return both.select(number.alias("chunk"), (F.lit(b.left) + F.col("tcol") * step_x).alias("left"), F.greatest(F.lit(b.bottom), F.lit(b.top) - (F.col("trow") + 1) * step_y).alias("bottom"), F.least(F.lit(b.right), F.lit(b.left) + (F.col("tcol") + 1) * step_x).alias("right"), (F.lit(b.top) - F.col("trow") * step_y).alias("top"))


def _utm_constants():
    e2 = FLAT * (2 - FLAT)
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    inverse = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    to_lat = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return math.sqrt(e2), radius, forward, inverse, to_lat


def lonlat_to_xy(lon, lat, crs: int, m=F):
    """Forward projection of degrees as columns (m: functions) or floats (m: math): lon/lat, Web Mercator, UTM (Krueger series)."""
    rad = math.pi / 180
    if is_geographic(crs):
        return lon, lat
    if crs == 3857:
        return lon * (rad * A), m.log(m.tan(lat * (rad / 2) + math.pi / 4)) * A
    zone, south = crs % 100, 32700 < crs <= 32760
    if not (32600 < crs <= 32660 or south):
        raise ValueError(f"EPSG:{crs} is not supported")
    e, radius, forward, _, _ = _utm_constants()
    phi, lam = lat * rad, (lon - (6 * zone - 183)) * rad
    s = m.sin(phi)
    t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
    xi, eta = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
    x, y = eta, xi
    for j, c in enumerate(forward, 1):
        x = x + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        y = y + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return x * (0.9996 * radius) + 500000.0, y * (0.9996 * radius) + (10000000.0 if south else 0.0)


def xy_to_lonlat(x, y, crs: int, m=F):
    deg = 180 / math.pi
    if is_geographic(crs):
        return x, y
    if crs == 3857:
        return x * (deg / A), m.atan(m.exp(y / A)) * (2 * deg) - 90.0
    zone, south = crs % 100, 32700 < crs <= 32760
    if not (32600 < crs <= 32660 or south):
        raise ValueError(f"EPSG:{crs} is not supported")
    _, radius, _, inverse, to_lat = _utm_constants()
    xi, eta = (y - (10000000.0 if south else 0.0)) / (0.9996 * radius), (x - 500000.0) / (0.9996 * radius)
    u, v = xi, eta
    for j, c in enumerate(inverse, 1):
        u = u - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        v = v - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(u) / m.cosh(v))
    phi = chi
    for j, c in enumerate(to_lat, 1):
        phi = phi + c * m.sin(2 * j * chi)
    return m.atan2(m.sinh(v), m.cos(u)) * deg + (6 * zone - 183), phi * deg


def _edge_box(b: Bounds, place) -> Bounds:
    """The box around a box's edge (21 points a side) after place(x, y)."""
    steps = [i / 20 for i in range(21)]
    edge = [(b.left + s * (b.right - b.left), y) for s in steps for y in (b.bottom, b.top)] + [(x, b.bottom + s * (b.top - b.bottom)) for s in steps for x in (b.left, b.right)]
    xs, ys = zip(*(place(x, y) for x, y in edge), strict=True)
    return Bounds(min(xs), min(ys), max(xs), max(ys))


def project_bounds(bounds, crs: int) -> Bounds:
    """Bounds in degrees to the box around their projected edge."""
    return _edge_box(Bounds.parse(bounds), lambda x, y: lonlat_to_xy(x, y, crs, math))


def bounds_in(grid: GridMeta, crs: int) -> Bounds:
    """The grid's bounds in another CRS."""
    if grid.crs == crs:
        return grid.bounds
    return _edge_box(grid.bounds, lambda x, y: lonlat_to_xy(*xy_to_lonlat(x, y, grid.crs, math), crs, math))


def common_bounds(grids: list[GridMeta], bounds_by: str = "reference") -> Bounds:
    """reference (the first), union or intersection of grids, in the first one's CRS."""
    found = grids[0].bounds
    for g in grids[1:] if bounds_by != "reference" else []:
        other = bounds_in(g, grids[0].crs)
        found = found.union(other) if bounds_by == "union" else found.intersection(other)
    if bounds_by not in ("reference", "union", "intersection"):
        raise ValueError(f"bounds_by is reference, union or intersection, not {bounds_by!r}")
    if found.left >= found.right or found.bottom >= found.top:
        raise ValueError("the images do not overlap")
    return found
