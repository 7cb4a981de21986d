"""Null-safe column helpers: missing data is NULL, never NaN or a sentinel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def clip(x, low, high) -> Column:
    """NULL stays NULL (greatest and least would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def finite(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clean(x, nodata=None, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Raw value to a double: the sentinel and NaN become NULL, then scaled."""
    v = finite(col(x).cast("double"))
    v = v if nodata is None else F.when(v != float(nodata), v)
    return v if scale == 1.0 and offset == 0.0 else v * scale + offset


def all_present(*columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & col(c).isNotNull()
    return out
