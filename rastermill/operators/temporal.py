"""Per-pixel statistics over time and composites: grouped aggregates, no Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, col

PIXEL = ["row", "col"]


def _unit(x: Column) -> Column:
    """[0, 0.05] to [0, 1]."""
    return clip(x / 0.05, 0, 1)


def stat(name: str, value: str = "value") -> Column:
    """max, min, mean, median, amp, cv, norm_abs_energy, percentileNN over what is not missing."""
    v = col(value)
    simple = {"max": F.max, "min": F.min, "mean": F.avg, "median": F.median}
    if name in simple:
        return simple[name](v)
    if name == "amp":
        return F.max(v) - F.min(v)
    if name == "cv":
        return F.stddev_pop(v) / (F.avg(v) + 1e-9)
    if name == "norm_abs_energy":
        return F.try_divide(F.sum(v * v), F.max(v) * F.max(v) * F.count(F.lit(1)))
    if m := re.fullmatch(r"percentile(\d{1,2}|100)", name):
        return F.percentile(v, F.lit(int(m[1]) / 100))
    raise ValueError(f"no statistic {name!r}")


def series_stats(df: DataFrame, names: list[str], value: str = "value", keys: list[str] = PIXEL) -> DataFrame:
    """A column for each statistic.  Order-dependent ones (mean_abs_diff, abs_slope_q1..q4) share one sort by pixel and time."""
    ordered = [n for n in names if n == "mean_abs_diff" or n.startswith("abs_slope_q")]
    if ordered:
        w = Window.partitionBy(*keys).orderBy("time")
        df = df.withColumns({"__diff": F.abs(col(value) - F.lag(value).over(w)), "__at": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "__clean": F.coalesce(col(value), F.lit(0.0))})
    aggs = []
    for n in names:
        if n == "mean_abs_diff":
            aggs.append(_unit(F.avg("__diff")).alias(n))
        elif m := re.fullmatch(r"abs_slope_q([1-4])", n):
            q = int(m[1])
            low, high = F.floor((q - 1) * 0.25 * F.col("__n")), F.floor(q * 0.25 * F.col("__n"))
            inside = (F.col("__at") >= low) & (F.col("__at") < high)
            slope = F.regr_slope(F.when(inside, F.col("__clean")), F.when(inside, F.col("__at").cast("double")))
            aggs.append(_unit(F.abs(slope)).alias(n))
        else:
            aggs.append(stat(n, value).alias(n))
    return df.groupBy(*keys).agg(*aggs)


def bucket(time: Column, freq: str, first: Column | None = None) -> Column:
    """Label of a period: D, nD, W (the Sunday on or after), nW, MS, nMS, QS, YS.  n-fold ones count from the first time."""
    n, unit = re.fullmatch(r"(\d*)(D|W|MS|QS|YS)", freq).groups()
    n = int(n or 1)
    day = F.to_date(time)
    if n == 1 and unit != "W":
        return F.to_timestamp({"D": day, "MS": F.trunc(day, "month"), "QS": F.trunc(day, "quarter"), "YS": F.trunc(day, "year")}[unit])
    sunday = lambda d: F.date_add(d, F.pmod(F.lit(8) - F.dayofweek(d), F.lit(7)))
    if n == 1:
        return F.to_timestamp(sunday(day))
    start = F.to_date(first)
    if unit == "D":
        return F.to_timestamp(F.date_add(start, (F.floor(F.datediff(day, start) / n) * n).cast("int")))
    if unit == "W":
        return F.to_timestamp(F.date_add(sunday(start), (F.ceil(F.datediff(day, sunday(start)) / (7 * n)) * (7 * n)).cast("int")))
    months = {"MS": n, "QS": 3 * n, "YS": 12 * n}[unit]
    base = F.trunc(start, {"MS": "month", "QS": "quarter", "YS": "year"}[unit])
    ahead = (F.year(day) - F.year(base)) * 12 + F.month(day) - F.month(base)
    return F.to_timestamp(F.add_months(base, (F.floor(ahead / months) * months).cast("int")))


def composite(df: DataFrame, freq: str, how: str = "median", values: list[str] | None = None, keys: list[str] = PIXEL) -> DataFrame:
    """time (the period's label) and a value for each pixel and period; periods without any value give no rows."""
    values = values or ["value"]
    first = None
    if not re.fullmatch(r"D|W|MS|QS|YS", freq):
        first = F.lit(df.agg(F.min("time")).first()[0])  # one value
    reducer = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}[how]
    made = df.groupBy(bucket(F.col("time"), freq, first).alias("time"), *keys).agg(*[reducer(v).alias(v) for v in values])
    return made.filter(F.coalesce(*values).isNotNull())


def flatten_time(df: DataFrame, bands: list[str], times: list, keys: list[str] = PIXEL, style: str = "{t}_{b}") -> DataFrame:
    """(time, band) to columns t1_b; times are given, so no extra pass is needed."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("time") == F.lit(t).cast("timestamp"), col(b))).alias(style.format(t=f"t{i}", b=b)) for i, t in enumerate(times, 1) for b in bands])


def orbit_factor(doy) -> Column:
    return 0.03275104 * F.cos(col(doy) / 59.66638337) + 0.96804905


def earth_sun_distance_squared(day) -> Column:
    """From the day of the year."""
    d = F.try_divide(F.lit(1.0), 1.0 - 0.0167 * F.cos(0.0172 * (col(day) - 2.0)))
    return d * d


def filename_date(name, pattern: str = r"(\d{8})") -> Column:
    """Date in a file name, NULL without one."""
    return F.try_to_date(F.nullif(F.regexp_extract(col(name), pattern, 1), F.lit("")), "yyyyMMdd")
