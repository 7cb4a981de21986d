"""Radiometric expressions: calibration, SREM surface reflectance, BRDF normalisation, topography.  Angles are in degrees here."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sensors import BRDF_WEIGHTS, MEAN_SZA, wavelengths
from .expr import all_present, clip, col, finite

PI = math.pi


def _cos(x) -> Column:
    return F.cos(F.radians(col(x)))


def _sin(x) -> Column:
    return F.sin(F.radians(col(x)))


def _tan(x) -> Column:
    return F.tan(F.radians(col(x)))


def dn_to_radiance(dn, gain: float, bias: float) -> Column:
    return col(dn) * gain + bias


def dn_to_toar(dn, gain: float, bias: float, sza=None) -> Column:
    out = col(dn) * gain + bias
    return out if sza is None else F.try_divide(out, _cos(sza))


def radiance_to_toar(radiance, sza, esun: float, distance_squared) -> Column:
    return F.try_divide(PI * col(radiance) * distance_squared, esun * _cos(sza))


def toar_to_radiance(toar, vza, irradiance: float, distance_squared) -> Column:
    return col(toar) * 1e4 * _cos(vza) * irradiance / (PI * distance_squared) * 1e-4


def relative_azimuth(saa, vaa) -> Column:
    """abs of the difference wrapped to [0, 360)."""
    return F.abs(F.pmod(col(saa) - col(vaa), F.lit(360.0)))


def scattering_cosine(sza, vza, raa) -> Column:
    """Cosine of the scattering angle."""
    return F.greatest(F.least(-_cos(sza) * _cos(vza) - _sin(sza) * _sin(vza) * _cos(raa), F.lit(1.0)), F.lit(-1.0))


def rayleigh_depth(nanometres: float) -> float:
    w = float(nanometres)
    return 0.008569 * w**-4 * (1 + 0.0113 * w**-2 + 0.0013 * w**-4)


#: Fixed value: depolarisation of the Rayleigh phase function.
DELTA = 0.9587256


def _phase(cosine) -> Column:
    return (3 * DELTA / (4 + 1 - DELTA)) * (1 + cosine * cosine)


def _airmass(cs, cv) -> Column:
    return F.try_divide(F.lit(1.0), cs) + F.try_divide(F.lit(1.0), cv)


def _scattered(tau: float, phase, airmass, cs, cv) -> Column:
    return F.try_divide(phase * (1 - F.exp(-airmass * tau)), 4 * (cs + cv))


def _transmitted(tau: float, c) -> Column:
    direct = F.exp(F.try_divide(F.lit(-tau), c))
    return direct + direct * (F.exp(F.try_divide(F.lit(0.52 * tau), c)) - 1)


def _below(tau: float, clear, through) -> Column:
    """Reflectance under a Rayleigh atmosphere: what is left after the path's share, over what passes it and is thrown back."""
    return F.try_divide(clear, clear * (0.92 * tau * math.exp(-tau)) + through)


def srem(toar, wavelength: float, sza, saa, vza, vaa) -> Column:
    """Surface reflectance without aerosol; wavelength in micrometres, taken as nanometres inside."""
    tau, cs, cv = rayleigh_depth(wavelength * 1000), _cos(sza), _cos(vza)
    phase = _phase(scattering_cosine(sza, vza, relative_azimuth(saa, vaa)))
    clear = col(toar) - _scattered(tau, phase, _airmass(cs, cv), cs, cv)
    return clip(finite(_below(tau, clear, _transmitted(tau, cs) * _transmitted(tau, cv))), 0, 1)


def toar_to_sr(df: DataFrame, bands: list[str], sensor: str, sza="sza", saa="saa", vza="vza", vaa="vaa") -> DataFrame:
    """SREM for each band; a pixel with any band missing is missing as a whole.

    What bands share, and what a band uses twice, are columns of their own, so each is computed once and the generated code stays small.
    """
    waves = wavelengths(sensor)
    depth = {b: rayleigh_depth(waves[b] * 1000) for b in bands}
    cs, cv, phase, airmass = (F.col(f"__{n}") for n in ("cs", "cv", "phase", "airmass"))
    held = df.withColumns({"__whole": all_present(*bands), "__cs": _cos(sza), "__cv": _cos(vza), "__cosine": scattering_cosine(sza, vza, relative_azimuth(saa, vaa))})
    held = held.withColumns({"__phase": _phase(F.col("__cosine")), "__airmass": _airmass(cs, cv)})
    held = held.withColumns({f"__clear_{b}": F.col(b) - _scattered(depth[b], phase, airmass, cs, cv) for b in bands})
    held = held.withColumns({f"__below_{b}": _below(depth[b], F.col(f"__clear_{b}"), _transmitted(depth[b], cs) * _transmitted(depth[b], cv)) for b in bands})
    held = held.withColumns({f"__below_{b}": finite(f"__below_{b}") for b in bands})
    return held.withColumns({b: F.when(F.col("__whole"), clip(f"__below_{b}", 0, 1)) for b in bands}).select(*df.columns)


def dn_to_sr(df: DataFrame, bands: list[str], sensor: str, gains: dict[str, float], biases: dict[str, float], sza="sza", saa="saa", vza="vza", vaa="vaa") -> DataFrame:
    toar = df.withColumns({b: dn_to_toar(b, gains[b], biases[b], sza) for b in bands})
    return toar_to_sr(toar, bands, sensor, sza, saa, vza, vaa)


def six_s(radiance, xa, xb, xc, doy) -> Column:
    """y = xa L - xb; y / (1 + xc y), coefficients from a look-up table scaled by the orbit's factor."""
    from ..operators.temporal import orbit_factor

    factor = orbit_factor(doy)
    y = col(radiance) * (col(xa) * factor) - col(xb) * factor
    return clip(F.try_divide(y, 1 + col(xc) * y), 0, 1)


def toar_coefficients_to_sr(toar, gas, path, up, down, sphere) -> Column:
    x = F.try_divide(F.try_divide(col(toar), col(gas)) - col(path), col(up) * col(down))
    return clip(F.try_divide(x, 1 + col(sphere) * x), 0, 1)


def dark_object_aot(df: DataFrame, blue_toar: str, swir2: str, coefficients: DataFrame, keys: list[str], fallback: float = 0.3) -> DataFrame:
    """AOT of each group of keys: over dark pixels the step of a coefficient table (aot, xa, xb, xc; at most 50 rows) whose corrected
    blue is nearest a third of swir2; groups without dark pixels get the fallback.  One aggregate: the score of each step is a mean."""
    dark = df.filter(F.col(swir2).between(0.01, 0.15)).select(*keys, F.col(blue_toar).alias("__l"), (F.col(swir2) * 0.33).alias("__aim"))
    y = F.col("xa") * F.col("__l") - F.col("xb")
    scored = dark.crossJoin(F.broadcast(coefficients)).groupBy(*keys, "aot").agg(F.avg(F.abs(F.try_divide(y, 1 + F.col("xc") * y) - F.col("__aim"))).alias("score"))
    best = scored.groupBy(*keys).agg(F.min_by("aot", F.struct("score", "aot")).alias("aot"))
    return df.select(*keys).distinct().join(best, keys, "left").withColumn("aot", F.coalesce("aot", F.lit(fallback)))


def li_ross(vza, sza, raa, br: float = 1.0, hb: float = 2.0) -> tuple[Column, Column]:
    """(Li sparse reciprocal, Ross thick) kernels."""
    tv, ts = F.greatest(br * _tan(vza), F.lit(0.0)), F.greatest(br * _tan(sza), F.lit(0.0))
    pv, ps, cr, sr = F.atan(tv), F.atan(ts), _cos(raa), _sin(raa)
    cos_phase = F.cos(pv) * F.cos(ps) + F.sin(pv) * F.sin(ps) * cr
    apart = F.greatest(tv * tv + ts * ts - 2.0 * tv * ts * cr, F.lit(0.0))
    secants = 1 / F.cos(pv) + 1 / F.cos(ps)
    cost = F.greatest(F.least(hb * F.sqrt(apart + tv * tv * ts * ts * sr * sr) / secants, F.lit(1.0)), F.lit(-1.0))
    t = F.acos(cost)
    overlap = F.greatest((t - F.sin(t) * cost) * secants / PI, F.lit(0.0))
    li = overlap - secants + 0.5 * (1 + cos_phase) / (F.cos(pv) * F.cos(ps))
    plain = F.greatest(F.least(_cos(vza) * _cos(sza) + _sin(vza) * _sin(sza) * cr, F.lit(1.0)), F.lit(-1.0))
    xi = F.acos(plain)
    ross = ((PI / 2 - xi) * plain + F.sin(xi)) / (_cos(vza) + _cos(sza)) - PI / 4
    return li, ross


def mean_sza(latitude) -> Column:
    out = F.lit(0.0)
    for c in reversed(MEAN_SZA):
        out = out * col(latitude) + c
    return out


def norm_brdf(df: DataFrame, bands: list[str], sza="sza", saa="saa", vza="vza", vaa="vaa", latitude=None, weight: float = 1.0) -> DataFrame:
    """c-factor: reflectance as from nadir at the latitude's mean solar zenith."""
    lat = F.lit(0.0) if latitude is None else F.lit(float(latitude)) if isinstance(latitude, (int, float)) else col(latitude)
    held = df.withColumn("__nadir", F.lit(0.0)).withColumn("__sza0", mean_sza(lat)).withColumn("__raa", relative_azimuth(saa, vaa))
    g0, v0 = li_ross("__nadir", "__sza0", "__nadir")
    g, v = li_ross(vza, sza, "__raa")
    held = held.withColumns({"__g0": g0, "__v0": v0, "__g": g, "__v": v})

    def one(b):
        iso, geo, vol = BRDF_WEIGHTS[b]
        nadir = iso + vol * F.col("__v0") * weight + geo * F.col("__g0")
        return F.try_divide(clip(b, 0, 1) * nadir, iso + vol * F.col("__v") * weight + geo * F.col("__g"))

    return held.withColumns({b: one(b) for b in bands}).drop("__nadir", "__sza0", "__raa", "__g0", "__v0", "__g", "__v")


def illumination(slope, aspect, sza, saa) -> Column:
    """Cosine of the sun's incidence on the slope (flat ground has no aspect)."""
    return _cos(slope) * _cos(sza) + F.coalesce(_sin(slope) * _sin(sza) * F.cos(F.radians(col(saa) - col(aspect))), F.lit(0.0))


def theil_sen(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), seed: int = 1) -> DataFrame:
    """keys, m, b: Theil's incomplete fit over all rows: each row of the lower half by x meets one of the upper half, by rank of a hash
    in buckets; m is the median slope of these pairs, b the median residual (both to 1 in 10,000 of rank).  No row is left out but
    for the few that a bucket has more of on one side."""
    rows = df.filter(all_present(x, y)).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    middle = rows.groupBy(*keys).agg(F.percentile_approx("x", 0.5, 10_000).alias("middle"), F.ceil(F.count(F.lit(1)) / 50_000).alias("n"))
    sided = (rows.join(F.broadcast(middle), list(keys)) if keys else rows.crossJoin(F.broadcast(middle))).withColumn("upper", F.col("x") > F.col("middle"))
    h = F.xxhash64(F.lit(seed), "x", "y")
    dealt = sided.withColumn("at", F.pmod(h, F.col("n"))).withColumn("place", F.row_number().over(Window.partitionBy(*keys, "upper", "at").orderBy(h, "x", "y")))
    low, high = dealt.filter("not upper").select(*keys, "at", "place", "x", "y"), dealt.filter("upper").select(*keys, "at", "place", F.col("x").alias("x1"), F.col("y").alias("y1"))
    slope = (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x"))
    slopes = low.join(high, [*keys, "at", "place"]).groupBy(*keys).agg(F.percentile_approx(slope, 0.5, 10_000).alias("m"))
    held = rows.join(F.broadcast(slopes), list(keys)) if keys else rows.crossJoin(F.broadcast(slopes))
    return held.groupBy(*keys, "m").agg(F.percentile_approx(F.col("y") - F.col("m") * F.col("x"), 0.5, 10_000).alias("b"))


def norm_topo(df: DataFrame, bands: list[str], method: str = "empirical-rotation", slope="slope", aspect="aspect", sza="sza", saa="saa", slope_thresh: float = 2, min_samples: int = 100, keys: tuple[str, ...] = (), robust: bool = False) -> DataFrame:
    """empirical-rotation, c or cos.  The regressions of all bands are one aggregate (per keys, such as time), joined back as one small
    table; robust fits them by theil_sen instead, band by band."""
    held = df.withColumns({"__il": illumination(slope, aspect, sza, saa), "__cz": _cos(sza)})
    steep = (col(slope) >= slope_thresh) & all_present(*bands)
    aggs = [f(F.when(steep, col(b)), F.when(steep, F.col("__il"))).alias(f"__{n}_{b}") for b in bands for n, f in (("m", F.regr_slope), ("b", F.regr_intercept))]
    fit = held.groupBy(*keys).agg(F.count(F.when(steep, 1)).alias("__n"), *aggs)
    if robust:
        for b in bands:
            line = theil_sen(held.filter(steep), "__il", b, keys).select(*keys, F.col("m").alias(f"__m_{b}"), F.col("b").alias(f"__b_{b}"))
            fit = fit.drop(f"__m_{b}", f"__b_{b}")
            fit = fit.join(line, list(keys), "left") if keys else fit.crossJoin(line)
    held = held.join(fit, list(keys)) if keys else held.crossJoin(F.broadcast(fit))

    def one(b):
        v, m, i = col(b), F.col(f"__m_{b}"), F.col(f"__b_{b}")
        if method == "cos":
            out = F.try_divide(v * F.col("__cz"), F.col("__il"))
            return F.when(steep, out).otherwise(v)
        if method == "c":
            c = F.try_divide(i, m)
            out = v * F.coalesce(F.try_divide(F.col("__cz") + c, F.col("__il") + c), F.lit(1.0))
            out = F.when(out > 1, v).otherwise(out)
        elif method == "empirical-rotation":
            out = clip(v - m * (F.col("__il") - F.col("__cz")), 0, 1)
        else:
            raise ValueError(f"no method {method!r}")
        return F.when(steep & (F.col("__n") >= min_samples) & out.isNotNull(), out).otherwise(v)

    return held.withColumns({b: one(b) for b in bands}).select(*df.columns)
