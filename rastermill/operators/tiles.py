"""User functions on tiles with a halo, image fusion kernels and shift estimation: numpy inside grouped maps of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import GridMeta


def map_tiles(df: DataFrame, bands: list[str], grid: GridMeta, fn: Callable, out: list[str], halo: int = 0, tile: int = 256) -> DataFrame:
    """fn(array[time, band, h, w], window) to array[len(out), h, w] on the padded tile; the padding is cut off again.

    The halo is reflected at the image's edge; missing cells are NaN; a tile with its halo is one group, whatever the image's size.
    NaN results come back as NULL.
    """
    timed = "time" in df.columns

    def places(axis: str, n: int):
        x = F.col(axis)
        held = F.filter(F.array(x, F.when(x < halo, -1 - x), F.when(x >= n - halo, 2 * n - 1 - x)), lambda v: v.isNotNull())
        return F.explode(held if halo else F.array(x))

    def tiles(axis: str, n: int):
        low, high = F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / tile)), F.least(F.lit((n - 1) // tile), F.floor((F.col(axis) + halo) / tile))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    dealt = df.withColumn("__r", places("row", grid.nrows)).withColumn("__c", places("col", grid.ncols)).withColumn("__trow", tiles("__r", grid.nrows)).withColumn("__tcol", tiles("__c", grid.ncols))
    nrows, ncols = grid.nrows, grid.ncols

    def run(key, rows):
        import pandas as pd

        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        h, w = min(tile, nrows - r0), min(tile, ncols - c0)
        times = np.sort(rows["time"].unique()) if timed else np.zeros(1)
        cube = np.full((len(times), len(bands), h + 2 * halo, w + 2 * halo), np.nan)
        at = np.searchsorted(times, rows["time"].to_numpy()) if timed else np.zeros(len(rows), int)
        i, j = rows["__r"].to_numpy() - r0 + halo, rows["__c"].to_numpy() - c0 + halo
        for k, b in enumerate(bands):
            cube[at, k, i, j] = rows[b].astype(float).to_numpy()
        made = np.asarray(fn(cube, (r0, c0, h, w)), float)[:, halo : halo + h, halo : halo + w]
        y, x = np.mgrid[r0 : r0 + h, c0 : c0 + w]
        return pd.DataFrame({"row": y.ravel().astype(np.int32), "col": x.ravel().astype(np.int32)} | {b: pd.Series(made[k].ravel()).astype(object).where(np.isfinite(made[k].ravel()), None) for k, b in enumerate(out)})

    keep = (["time"] if timed else []) + ["__r", "__c", "__trow", "__tcol", *bands]
    return dealt.select(*keep).groupBy("__trow", "__tcol").applyInPandas(run, "row int, col int, " + ", ".join(f"{b} double" for b in out))


class TimeModule:
    """Subclass with calculate(array[time, band, h, w]) to array[count, h, w]; modules are added to a pipeline."""

    count, names = 1, None

    def calculate(self, array: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def outputs(self) -> list[str]:
        return list(self.names or [f"{type(self).__name__.lower()}{i + 1}" for i in range(self.count)])

    def __add__(self, other):
        return TimeModulePipeline([self]) + other


class TimeModulePipeline(TimeModule):
    def __init__(self, modules: list[TimeModule]):
        self.modules = list(modules)

    def __add__(self, other):
        return TimeModulePipeline(self.modules + (other.modules if isinstance(other, TimeModulePipeline) else [other]))

    def outputs(self):
        return [n for m in self.modules for n in m.outputs()]

    def calculate(self, array):
        return np.concatenate([np.reshape(m.calculate(array), (-1, *array.shape[2:])) for m in self.modules])


def apply_module(df: DataFrame, bands: list[str], grid: GridMeta, module: TimeModule, tile: int = 256) -> DataFrame:
    return map_tiles(df, bands, grid, lambda cube, _: module.calculate(cube), module.outputs(), 0, tile)


def _windows(a: np.ndarray, w: int) -> np.ndarray:
    half = w // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, half, mode="symmetric"), (w, w))


def starfm_kernel(h0: np.ndarray, m0: np.ndarray, m1: np.ndarray, window: int = 25, uncertainty: float = 0.003, spatial: float = 25.0, classes: int = 4) -> np.ndarray:
    """Fine image at the second date from fine h0 and coarse m0 (same date) and coarse m1: weighted by spectral, temporal and spatial
    likeness over similar neighbours no worse than the centre."""
    half = window // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    distance = 1 + np.hypot(y, x) / spatial
    wh, w0, w1 = (_windows(a, window) for a in (h0, m0, m1))
    spectral, change = np.abs(wh - w0) + uncertainty, np.abs(w1 - w0) + uncertainty
    spread = np.nanstd(wh, axis=(2, 3), keepdims=True) * 2 / classes
    own = np.abs(h0 - m0)[..., None, None] + 2 * uncertainty
    similar = (np.abs(wh - h0[..., None, None]) <= spread) & (spectral <= own) & np.isfinite(wh) & np.isfinite(w0) & np.isfinite(w1)
    similar[..., half, half] = np.isfinite(h0 + m0 + m1)
    weight = np.where(similar, 1 / (spectral * change * distance), 0.0)
    total = weight.sum((2, 3))
    value = np.where(similar, w1 + wh - w0, 0.0)
    return np.divide((weight * value).sum((2, 3)), total, out=np.full(h0.shape, np.nan), where=total > 0)


def starfm(df: DataFrame, grid: GridMeta, fine: str, coarse: str, coarse_next: str, window: int = 25, tile: int = 128) -> DataFrame:
    """row, col, fused."""
    return map_tiles(df, [fine, coarse, coarse_next], grid, lambda cube, _: starfm_kernel(*cube[0], window=window)[None], ["fused"], window // 2, tile)


def improphe_kernel(fine: np.ndarray, coarse: np.ndarray, window: int = 25) -> np.ndarray:
    """Coarse values predicted at fine scale: neighbours weighted by logistic scores of spectral likeness, texture and distance."""
    half = window // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    score = lambda d: 1 / (1 + np.exp(np.clip(25 * d - 7.5, -50, 50)))
    wf, wc = _windows(fine, window), _windows(coarse, window)
    texture = _windows(np.nanstd(_windows(fine, 3), axis=(2, 3)), window)
    scaled = lambda d: d / np.maximum(np.nanmax(d, axis=(2, 3), keepdims=True), 1e-12)
    near = scaled(np.hypot(y, x)[None, None] + 0 * wf)
    weight = score(scaled(np.abs(wf - fine[..., None, None]))) * score(scaled(np.abs(texture - texture[..., half : half + 1, half : half + 1]))) * score(near)
    weight = np.where(np.isfinite(wc) & np.isfinite(weight), weight, 0.0)
    total = weight.sum((2, 3))
    return np.divide((weight * np.nan_to_num(wc)).sum((2, 3)), total, out=np.full(fine.shape, np.nan), where=total > 0)


def improphe(df: DataFrame, grid: GridMeta, fine: str, coarse: str, window: int = 25, tile: int = 128) -> DataFrame:
    return map_tiles(df, [fine, coarse], grid, lambda cube, _: improphe_kernel(*cube[0], window=window)[None], ["predicted"], window // 2, tile)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(rows, cols) by which b is moved against a, from the peak of the phase correlation."""
    fa, fb = np.fft.fft2(np.nan_to_num(a - np.nanmean(a))), np.fft.fft2(np.nan_to_num(b - np.nanmean(b)))
    cross = fb * np.conj(fa)
    peak = np.unravel_index(np.argmax(np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))), a.shape)
    return tuple(int(p) if p <= n // 2 else int(p) - n for p, n in zip(peak, a.shape, strict=True))


def coregister(df: DataFrame, reference: str, target: str, grid: GridMeta, tile: int = 256) -> tuple[DataFrame, int, int]:
    """(df with the target moved back, row shift, col shift): each tile votes for its shift, the most frequent one holds."""
    votes = map_tiles(df, [reference, target], grid, lambda cube, _: np.broadcast_to(np.array(phase_shift(*cube[0]))[:, None, None], (2, *cube.shape[2:])), ["dr", "dc"], 0, tile)
    dr, dc, _ = max(votes.groupBy("dr", "dc").count().collect(), key=lambda r: (r["count"], -abs(r.dr) - abs(r.dc)))
    moved = df.select((F.col("row") - int(dr)).alias("row"), (F.col("col") - int(dc)).alias("col"), target)
    return df.drop(target).join(moved, ["row", "col"], "left"), int(dr), int(dc)
