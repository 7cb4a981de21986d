"""Sensor constants."""

from __future__ import annotations

#: Central wavelengths in micrometres by platform.
WAVELENGTHS = {
    "l5": {"blue": 0.485, "green": 0.56, "red": 0.66, "nir": 0.835, "swir1": 1.65, "swir2": 2.22},
    "l7": {"blue": 0.485, "green": 0.56, "red": 0.66, "nir": 0.835, "swir1": 1.65, "thermal": 11.45, "swir2": 2.22, "pan": 0.71},
    "l8": {"coastal": 0.44, "blue": 0.48, "green": 0.56, "red": 0.655, "nir": 0.865, "swir1": 1.61, "swir2": 2.2, "cirrus": 1.37, "pan": 0.59},
    "s2": {"coastal": 0.443, "blue": 0.49, "green": 0.56, "red": 0.665, "nir1": 0.705, "nir2": 0.74, "nir3": 0.783, "nir": 0.842, "rededge": 0.865, "water": 0.945, "cirrus": 1.375, "swir1": 1.61, "swir2": 2.19},
    "s2a": {"coastal": 0.4427, "blue": 0.4924, "green": 0.5598, "red": 0.6646, "nir1": 0.7041, "nir2": 0.7405, "nir3": 0.7828, "nir": 0.8328, "rededge": 0.8647, "water": 0.9451, "cirrus": 1.3735, "swir1": 1.6137, "swir2": 2.2024},
    "s2b": {"coastal": 0.4423, "blue": 0.4921, "green": 0.559, "red": 0.665, "nir1": 0.7038, "nir2": 0.7391, "nir3": 0.7797, "nir": 0.833, "rededge": 0.864, "water": 0.9432, "cirrus": 1.3769, "swir1": 1.6104, "swir2": 2.1857},
    "ps": {"blue": 0.485, "green": 0.545, "red": 0.63, "nir": 0.82},
}
WAVELENGTHS["l9"] = WAVELENGTHS["l8"]

#: Solar irradiance of Sentinel-2 in W per square metre and micrometre.
SOLAR_IRRADIANCE = {
    "s2a": {"coastal": 1913.57, "blue": 1941.63, "green": 1822.61, "red": 1512.79, "nir1": 1425.56, "nir2": 1288.32, "nir3": 1163.19, "nir": 1036.39, "rededge": 955.19, "water": 813.04, "cirrus": 367.15, "swir1": 245.59, "swir2": 85.25},
    "s2b": {"coastal": 1874.3, "blue": 1959.75, "green": 1824.93, "red": 1512.79, "nir1": 1425.78, "nir2": 1291.13, "nir3": 1175.57, "nir": 1041.28, "rededge": 953.93, "water": 817.58, "cirrus": 365.41, "swir1": 247.08, "swir2": 87.75},
}
#: Altitude in km.
ALTITUDE = {"aster": 705, "l5": 705, "l7": 705, "l8": 705, "s2": 786, "ps": 475, "qb": 482, "ik": 681, "wv3": 617}

_VISIBLE = ("blue", "green", "red", "nir")
_SIX = (*_VISIBLE, "swir1", "swir2")
_EDGES = ("nir1", "nir2", "nir3")
_S2 = ("blue", "green", "red", *_EDGES, "nir", "rededge", "swir1", "swir2")
_S2FULL = ("coastal", *_S2[:8], "water", "cirrus", "swir1", "swir2")
_S2CLOUD = ("coastal", "blue", "red", "nir1", "nir", "rededge", "water", "cirrus", "swir1", "swir2")
_OLI = ("coastal", *_SIX, "cirrus")
_MODIS = ("red", "nir", "blue", "green", "nir2", "swir1", "swir2")

#: Band orders by sensor name, built by family.
SENSORS: dict[str, tuple[str, ...]] = {"rgb": ("red", "green", "blue"), "rgbn": ("red", "green", "blue", "nir"), "bgr": ("blue", "green", "red"), "bgrn": _VISIBLE, "l5": _SIX, "l7": _SIX, "l4": _VISIBLE}
SENSORS |= {"l7th": (*_SIX[:5], "thermal", "swir2"), "l7mspan": (*_SIX, "pan"), "l7pan": ("pan",), "l5bgrn": _VISIBLE, "l7bgrn": _VISIBLE, "l8bgrn": _VISIBLE}
for _n in ("l8", "l9"):
    SENSORS |= {_n: _OLI, f"{_n}th": (*_OLI, "tirs1", "tirs2"), f"{_n}l7": _SIX, f"{_n}l7mspan": (*_SIX, "pan"), f"{_n}pan": ("pan",)}
for _n in ("s2", "s2a", "s2b"):
    SENSORS |= {_n: _S2, f"{_n}f": _S2FULL, f"{_n}l7": _SIX, f"{_n}10": _VISIBLE, f"{_n}20": (*_EDGES, "rededge", "swir1", "swir2"), f"{_n}cloudless": _S2CLOUD}
SENSORS |= dict.fromkeys(("ps", "qb", "ik", "cbers2"), _VISIBLE) | dict.fromkeys(("mcd43a4", "mod09a1", "myd09a1", "modis"), _MODIS) | {"rapideye": ("blue", "green", "red", "rededge", "nir"), "aster": ("green", "red", "nir", *(f"swir{i}" for i in range(1, 7)))}


def wavelengths(sensor: str) -> dict[str, float]:
    """Of the bands of a sensor, by its platform (the longest name that begins it)."""
    platform = max((p for p in WAVELENGTHS if sensor.startswith(p)), key=len, default=None)
    return {b: WAVELENGTHS[platform][b] for b in SENSORS[sensor] if b in WAVELENGTHS[platform]} if platform else {}


#: Tasseled cap; a row for each band in sensor order, columns brightness, greenness, wetness.
TASSELED_CAP = {
    "aster": [[0.3909, -0.0318, 0.4571], [0.5224, -0.1031, 0.4262], [0.1184, 0.9422, -0.1568], [0.3233, 0.2512, 0.2809], [0.305, -0.0737, -0.2417], [0.3571, -0.069, -0.3269], [0.3347, -0.0957, -0.4077], [0.3169, -0.1195, -0.3731], [0.151, -0.0625, -0.1877]],
    "cbers2": [[0.509, -0.494, 0.581], [0.431, -0.318, -0.07], [0.33, -0.324, -0.811], [0.668, 0.741, 0.003]],
    "ik": [[0.326, -0.311, -0.612], [0.509, -0.256, -0.312], [0.56, -0.325, 0.722], [0.567, 0.819, -0.081]],
    "l4": [[0.433, -0.29, -0.829], [0.632, -0.562, 0.522], [0.586, 0.6, -0.039], [0.264, 0.491, 0.194]],
    "l5": [[0.3037, -0.2848, 0.1509], [0.2793, -0.2435, 0.1793], [0.4343, -0.5436, 0.3299], [0.5585, 0.7243, 0.3406], [0.5082, 0.084, -0.7112], [0.1863, -0.18, -0.4572]],
    "l7": [[0.3561, -0.3344, 0.2626], [0.3972, -0.3544, 0.2141], [0.3904, -0.4556, 0.0926], [0.6966, 0.6966, 0.0656], [0.2286, -0.0242, -0.7629], [0.1596, -0.263, -0.5388]],
    "l8": [[0.3029, -0.2941, 0.1511], [0.2786, -0.243, 0.1973], [0.4733, -0.5424, 0.3283], [0.5599, 0.7276, 0.3407], [0.508, 0.0713, -0.7117], [0.1872, -0.1608, -0.4559]],
    "modis": [[0.4395, -0.4064, 0.1147], [0.5945, 0.5129, 0.2489], [0.246, -0.2744, 0.2408], [0.3918, -0.2893, 0.3132], [0.3506, 0.4882, -0.3122], [0.2136, -0.0036, -0.6416], [0.2678, -0.4169, -0.5087]],
    "qb": [[0.319, -0.121, 0.652], [0.542, -0.331, 0.375], [0.49, -0.517, -0.639], [0.604, 0.78, -0.163]],
    "rapideye": [[-0.293, -0.406, 0.572], [-0.354, -0.367, 0.402], [-0.372, -0.446, -0.494], [-0.44, -0.128, -0.498], [-0.676, 0.697, 0.138]],
}

#: Bandpass adjustment to Landsat 8 as (alpha, beta).
BANDPASS = {
    "s2a": {"coastal": (-0.0002, 0.9959), "blue": (-0.004, 0.9778), "green": (-0.0009, 1.0053), "red": (0.0009, 0.9765), "nir": (-0.0001, 0.9983), "swir1": (-0.0011, 0.9987), "swir2": (-0.0012, 1.003)},
    "s2b": {"coastal": (-0.0002, 0.9959), "blue": (-0.004, 0.9778), "green": (-0.0008, 1.0075), "red": (0.001, 0.9761), "nir": (0.0, 0.9966), "swir1": (-0.0003, 1.0), "swir2": (0.0004, 0.9867)},
    "l7": {"blue": (-0.0095, 0.9785), "green": (-0.0016, 0.9542), "red": (-0.0022, 0.9825), "nir": (-0.0021, 1.0073), "swir1": (-0.003, 1.0171), "swir2": (0.0029, 0.9949), "pan": (-0.00443, 0.9717)},
}
BANDPASS["l5"] = BANDPASS["l7"]

#: BRDF weights (isotropic, geometric, volumetric).
BRDF_WEIGHTS = {"blue": (0.0774, 0.0079, 0.0372), "green": (0.1306, 0.0178, 0.058), "red": (0.169, 0.0227, 0.0574), "nir": (0.3093, 0.033, 0.1535), "swir1": (0.343, 0.0453, 0.1154), "swir2": (0.2658, 0.0387, 0.0639), "pan": (0.12567, 0.01613, 0.0509)}
#: Mean solar zenith by latitude, coefficients of rising powers.
MEAN_SZA = (31.0076, -0.1272, 0.01187, 2.40e-05, -9.48e-07, -1.95e-09, 6.15e-11)

#: QA items as (high bit, low bit).
QA_BITS = {
    "hls": {"cirrus": (0, 0), "cloud": (1, 1), "adjacent": (2, 2), "shadow": (3, 3), "snowice": (4, 4), "water": (5, 5)},
    "l8-pre": {"cirrus": (13, 12), "snowice": (11, 10), "water": (5, 4), "fill": (0, 0), "dropped": (1, 1), "terrain": (2, 2), "shadow": (7, 6), "vegconf": (9, 8), "snowiceconf": (11, 10), "cirrusconf": (13, 12), "cloudconf": (15, 14)},
    "l8-c1": {"cirrusconf": (12, 11), "snowiceconf": (10, 9), "shadowconf": (8, 7), "cloudconf": (6, 5), "cloud": (4, 4), "saturated": (3, 2), "terrain": (1, 1), "fill": (0, 0)},
    "l-c1": {"fill": (0, 0), "dropped": (1, 1), "saturated": (3, 2), "cloud": (4, 4), "cloudconf": (6, 5), "shadowconf": (8, 7), "snowice": (10, 9)},
    "ard": {"fill": (0, 0), "clear": (1, 1), "water": (2, 2), "shadow": (3, 3), "snow": (4, 4), "cloud": (5, 5)},
    "modis": {"cloud": (0, 0), "daynight": (3, 3), "sunglint": (4, 4), "snowice": (5, 5), "landwater": (7, 6)},
    "s2a": {"cloud": (10, 10), "cirrus": (11, 11)},
    "s2c": {"cloud": (10, 10), "cirrus": (11, 11)},
}
QA_CODES = {"clear": 0, "water": 1, "shadow": 2, "shadowconf": 2, "snow": 3, "snowice": 3, "snowiceconf": 3, "cloud": 4, "cloudconf": 4, "cirrus": 5, "cirrusconf": 5, "adjacent": 6, "saturated": 7, "dropped": 8, "terrain": 0, "fill": 255}
CONFIDENCE = {"notdet": 0, "no": 1, "maybe": 2, "yes": 3}
LANDSAT_BITS = {"fill": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "cloud_shadow": 4, "snow": 5, "clear": 6, "water": 7}
SCL_VALUES = {"no_data": 0, "saturated_defective": 1, "dark_area": 2, "cloud_shadow": 3, "vegetation": 4, "not_vegetated": 5, "water": 6, "unclassified": 7, "cloud_medium_prob": 8, "cloud_high_prob": 9, "thin_cirrus": 10, "snow_ice": 11}
FMASK_BITS = {"cirrus": 0, "cloud": 1, "adjacent_cloud": 2, "cloud_shadow": 3, "snow_ice": 4, "water": 5}
HLS_L30 = {"coastal": "B01", "blue": "B02", "green": "B03", "red": "B04", "nir": "B05", "swir1": "B06", "swir2": "B07", "cirrus": "B09", "thermal1": "B10", "thermal2": "B11"}
HLS_S30 = {"coastal": "B01", "blue": "B02", "green": "B03", "red": "B04", "rededge1": "B05", "rededge2": "B06", "rededge3": "B07", "nir_broad": "B08", "nir": "B8A", "water_vapor": "B09", "cirrus": "B10", "swir1": "B11", "swir2": "B12"}
#: Gain, offset and nodata of catalog collections.
COLLECTION_SCALING = {"landsat_c2_l2": (2.75e-05, -0.2, 0), "hls_l30": (1e-4, 0.0, -9999), "hls_s30": (1e-4, 0.0, -9999)}


def hls_band(band: str, collection: str) -> str:
    """Asset key of a band; unknown names pass through."""
    return (HLS_L30 if "l30" in collection.lower() else HLS_S30).get(band, band)
