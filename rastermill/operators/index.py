"""Vegetation indices, tasseled cap, linear transforms and value maps as Catalyst expressions."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import all_present, clean, clip, col, finite, ratio
from ..sensors import BANDPASS, SENSORS, TASSELED_CAP


@dataclass(frozen=True)
class Index:
    bands: tuple[str, ...]
    formula: Callable[..., Column]
    low: float
    high: float
    per: float = 1.0


def _difference(a, b):
    return ratio(b - a, b + a)


INDICES = {
    "ndvi": Index(("red", "nir"), _difference, -1, 1),
    "nbr": Index(("swir2", "nir"), _difference, -1, 1),
    "kndvi": Index(("red", "nir"), lambda red, nir: F.tanh(_difference(red, nir) * _difference(red, nir)), -1, 1),
    "evi": Index(("blue", "red", "nir"), lambda blue, red, nir: ratio(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0), 0, 1),
    "evi2": Index(("red", "nir"), lambda red, nir: ratio(2.5 * (nir - red), nir + 1.0 + 2.4 * red), 0, 1),
    "avi": Index(("red", "nir"), lambda red, nir: F.when(nir * (1.0 - red) * (nir - red) >= 0, F.pow(nir * (1.0 - red) * (nir - red), F.lit(0.3334))), 0, 1),
    "gcvi": Index(("green", "nir"), lambda green, nir: ratio(nir, green) - 1.0, 0, 10, 10.0),
    "wi": Index(("red", "swir1"), lambda red, swir1: F.when(swir1 + red > 0.5, 0.0).when((swir1 + red).isNotNull(), 1.0 - (swir1 + red) / 0.5), 0, 1),
}


def index(name: str, nodata=None, scale: float = 1.0, mask: Column | None = None, **bands) -> Column:
    """One index by name; every input is masked on its raw value, clipping leaves NULL alone.  mask: kept where below 3.
    bands: other column names, such as red="b3"."""
    spec = INDICES[name]
    values = [clean(bands.get(b, b), nodata, scale) for b in spec.bands]
    out = clip(finite(spec.formula(*values)), spec.low, spec.high)
    out = out / spec.per if spec.per != 1 else out
    return (out if mask is None else F.when(mask < 3, out)).alias(name)


def norm_diff(b1: str, b2: str, nodata=None, scale: float = 1.0, mask: Column | None = None) -> Column:
    """(b2 - b1) / (b2 + b1)."""
    out = clip(_difference(clean(b1, nodata, scale), clean(b2, nodata, scale)), -1, 1)
    return (out if mask is None else F.when(mask < 3, out)).alias("norm_diff")


def tasseled_cap(sensor: str, nodata=None, scale: float = 1.0, bands: tuple[str, ...] | None = None) -> list[Column]:
    """brightness, greenness, wetness; NULL where any band is."""
    rows = TASSELED_CAP[sensor]
    names = bands or (SENSORS["l8l7"] if sensor == "l8" else SENSORS[sensor])
    values = [clean(b, nodata, scale) for b in names[: len(rows)]]
    out = []
    for k, name in enumerate(("brightness", "greenness", "wetness")):
        total = values[0] * rows[0][k]
        for v, r in zip(values[1:], rows[1:], strict=True):
            total = total + v * r[k]
        out.append(total.alias(name))
    return out


def linear_transform(df: DataFrame, scale: dict[str, float], offset: dict[str, float]) -> DataFrame:
    return df.withColumns({b: col(b) * scale[b] + offset[b] for b in scale})


def bandpass(df: DataFrame, sensor: str, bands: list[str], nodata=None, scale: float = 1.0) -> DataFrame:
    """Adjusted to Landsat 8: scaled, alpha + beta * v, scaled back."""
    table = BANDPASS[sensor]
    return df.withColumns({b: (table[b][0] + table[b][1] * clean(b, nodata, scale)) / scale for b in bands})


def set_nodata(df: DataFrame, bands: list[str], src=None, dst=None, out_range: tuple | None = None, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """The sentinel becomes dst (or NULL), other values are scaled and clipped."""

    def one(b):
        v = clean(b, src, scale, offset)
        v = v if out_range is None else clip(v, *out_range)
        return v if dst is None else F.coalesce(v, F.lit(float(dst)))

    return df.withColumns({b: one(b) for b in bands})


def mask_nodata(df: DataFrame, bands: list[str], nodata) -> DataFrame:
    return df.withColumns({b: F.nullif(col(b), F.lit(nodata)) for b in bands})


def pixel_mask(df: DataFrame, bands: list[str], nodata) -> DataFrame:
    """A pixel with any band missing is missing as a whole."""
    good = all_present(*[F.nullif(col(b), F.lit(nodata)) for b in bands])
    return df.withColumns({b: F.when(good, col(b)) for b in bands})


def replace_values(df: DataFrame, bands: list[str], to_replace: dict) -> DataFrame:
    """All values mapped at once (a chain of replacements can't meet itself)."""

    def one(b):
        out = None
        for k, v in to_replace.items():
            out = (F if out is None else out).when(col(b) == k, F.lit(v).cast(df.schema[b].dataType))
        return out.otherwise(col(b)) if out is not None else col(b)

    return df.withColumns({b: one(b) for b in bands})


def compare(df: DataFrame, bands: list[str], op: str, value: float, binary: bool = False) -> DataFrame:
    """Values that satisfy op (lt le gt ge eq ne), or 1 for them; NULL elsewhere."""
    return df.withColumns({b: F.when(condition(b, op, value), F.lit(1.0) if binary else col(b)) for b in bands})


def condition(b, op: str, value) -> Column:
    x = col(b)
    found = {"lt": lambda: x < value, "le": lambda: x <= value, "gt": lambda: x > value, "ge": lambda: x >= value, "eq": lambda: x == value, "ne": lambda: x != value}
    found |= {"<": found["lt"], "<=": found["le"], ">": found["gt"], ">=": found["ge"], "==": found["eq"], "!=": found["ne"]}
    return found[op]()
