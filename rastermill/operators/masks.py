"""Quality bits, class masks and cloud shadows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col
from ..sensors import CONFIDENCE, FMASK_BITS, LANDSAT_BITS, QA_BITS, QA_CODES, SCL_VALUES


def qa_codes(qa, sensor: str, items: list[str] | None = None, confidence: str = "yes") -> Column:
    """Class code of a bit-packed value: later items overwrite earlier ones, 0 is clear."""
    table = QA_BITS[sensor.lower()]
    out = F.lit(QA_CODES["clear"])
    for item in items or [i for i in table if i in QA_CODES]:
        high, low = table[item]
        value = F.shiftright(col(qa), low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1))
        out = F.when(value >= (CONFIDENCE[confidence] if item.endswith("conf") else 1), QA_CODES[item]).otherwise(out)
    return F.when(col(qa).isNotNull(), out)


def _bits(qa, bits: list[int]) -> Column:
    return col(qa).bitwiseAND(F.lit(sum(1 << b for b in set(bits)))) == 0


def landsat_clear(qa, items=("fill", "dilated_cloud", "cirrus", "cloud", "cloud_shadow", "snow")) -> Column:
    return _bits(qa, [LANDSAT_BITS[i] for i in items])


def fmask_clear(qa, items=("cirrus", "cloud", "adjacent_cloud", "cloud_shadow", "snow_ice")) -> Column:
    return _bits(qa, [FMASK_BITS[i] for i in items])


def scl_clear(scl, items=("no_data", "saturated_defective", "cloud_shadow", "cloud_medium_prob", "cloud_high_prob", "thin_cirrus")) -> Column:
    return ~col(scl).isin([SCL_VALUES[i] for i in items])


def keep_where(df: DataFrame, bands: list[str], keep: Column) -> DataFrame:
    return df.withColumns({b: F.when(keep, col(b)) for b in bands})


def band_mask(bands: list[str], nodata=None, clear: int = 0, masked: int = 1) -> Column:
    """masked where fewer than all bands are above zero, or the first is nodata."""
    good = sum((F.coalesce((col(b) > 0).cast("int"), F.lit(0)) for b in bands), F.lit(0))
    bad = good < len(bands)
    return F.when(bad if nodata is None else bad | (col(bands[0]) == nodata), masked).otherwise(clear)


def cloud_shadows(df: DataFrame, cloud: str, sza: str, saa: str, celly: float, heights: list[float], swir2: str = "swir2", green: str = "green", least: float = 0.1) -> DataFrame:
    """Adds shadow (0/1): a cloud cast along the sun's ray from any height, not cloud itself, where (green - swir2) / (green + swir2) is at least `least`.

    Every cloud pixel is exploded to its few landing places and joined back on (row, col): equi-joins only.  Angles in degrees.
    """
    keys = [k for k in ("time", "row", "col") if k in df.columns]
    zenith, azimuth = F.radians(col(sza)), F.radians(col(saa))
    reach = F.explode(F.array(*[F.lit(float(h)) for h in heights])).alias("height")
    cast = df.filter(col(cloud) == 1).select(*keys, zenith.alias("z"), azimuth.alias("a"), reach)
    far = F.tan("z") * F.col("height") / celly
    landed = cast.select(*[k for k in keys if k == "time"], (F.col("row") + F.round(F.cos("a") * far)).cast("int").alias("row"), (F.col("col") - F.round(F.sin("a") * far)).cast("int").alias("col")).distinct().withColumn("cast_here", F.lit(True))
    dark = F.try_divide(col(green) - col(swir2), col(green) + col(swir2)) >= least
    shadow = F.coalesce(F.col("cast_here") & (col(cloud) != 1) & dark, F.lit(False))
    return df.join(landed, keys, "left").withColumn("shadow", shadow.cast("int")).drop("cast_here")


def cloud_or_shadow(df: DataFrame, cloud: str, sza: str, saa: str, celly: float, heights=(200, 400, 600, 800, 1000, 1200), nir: str = "nir", swir1: str = "swir1") -> DataFrame:
    """Adds mask: 1 cloud, 2 shadow (dark in nir and swir1 where a cloud is cast), 0 else."""
    made = cloud_shadows(df.withColumns({"__one": F.lit(1.0), "__zero": F.lit(0.0)}), cloud, sza, saa, celly, list(heights), "__zero", "__one", -math.inf)
    return made.withColumn("mask", F.when(col(cloud) == 1, 1).when((F.col("shadow") == 1) & (col(nir) < 0.25) & (col(swir1) < 0.11), 2).otherwise(0)).drop("shadow", "__one", "__zero")
