"""Explicit settings with an optional context: settings win over arguments, arguments over file metadata."""

from __future__ import annotations

import contextlib
import contextvars
from dataclasses import dataclass, replace

from .grid import Bounds, GridMeta, parse_crs


@dataclass(frozen=True)
class RasterConfig:
    sensor: str | None = None
    scale_factor: float | None = None
    offset: float | None = None
    nodata: float | None = None
    ref_image: GridMeta | None = None
    ref_bounds: object = None
    ref_crs: object = None
    ref_res: object = None
    ref_tar: GridMeta | None = None
    blocksize: int = 512
    compress: str | None = None
    ignore_warnings: bool = False

    def value(self, name: str, argument, metadata):
        """nodata, scale_factor, offset: setting, else argument, else metadata."""
        own = getattr(self, name)
        return own if own is not None else argument if argument is not None else metadata

    def band_names(self, explicit, sensor, n: int) -> tuple[str, ...]:
        """Here explicit names win; then the sensor's; else 1..n."""
        from .sensors import SENSORS

        if explicit:
            return tuple(map(str, explicit))
        name = self.sensor or sensor
        if name and len(SENSORS[name]) == n:
            return SENSORS[name]
        return tuple(str(i + 1) for i in range(n))

    def resolve_grid(self, own: GridMeta) -> GridMeta:
        """ref_image sets bounds, CRS and resolution together; else the single settings apply; ref_tar aligns to its cells."""
        if self.ref_image:
            r = self.ref_image
            return own.replace(left=r.left, top=r.top, cellx=r.cellx, celly=r.celly, nrows=r.nrows, ncols=r.ncols, crs=r.crs)
        if self.ref_crs is not None:
            own = own.in_crs(parse_crs(self.ref_crs))
        bounds = Bounds.parse(self.ref_bounds) if self.ref_bounds is not None else own.bounds
        res = self.ref_res if self.ref_res is not None else own.res
        crs = own.crs
        if self.ref_tar:
            t = self.ref_tar
            shift = lambda v, o, c: o + round((v - o) / c) * c
            bounds = Bounds(shift(bounds.left, t.left, t.cellx), shift(bounds.bottom, t.top, t.celly), shift(bounds.right, t.left, t.cellx), shift(bounds.top, t.top, t.celly))
            res = t.res
        got = GridMeta.from_bounds(bounds, res, crs)
        return own.replace(left=got.left, top=got.top, cellx=got.cellx, celly=got.celly, nrows=got.nrows, ncols=got.ncols, crs=crs)


_current: contextvars.ContextVar[RasterConfig] = contextvars.ContextVar("rastermill_config", default=RasterConfig())


def current() -> RasterConfig:
    return _current.get()


@contextlib.contextmanager
def configured(**settings):
    """Settings inside the block; the ones before come back at its end."""
    token = _current.set(replace(_current.get(), **settings))
    try:
        yield _current.get()
    finally:
        _current.reset(token)
