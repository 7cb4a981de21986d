"""A chain of named tasks over frames, and the scene-to-cube chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import RasterFrame
from ..functions import radiometry
from ..operators import index, masks


@dataclass
class Pipeline:
    """tasks: (name, function, names of its inputs); an input is a given frame or an earlier task; writes name sinks by task."""

    inputs: dict[str, object]
    tasks: list[tuple[str, Callable, tuple[str, ...]]] = field(default_factory=list)
    writes: dict[str, str] = field(default_factory=dict)

    def then(self, name: str, fn: Callable, *uses: str) -> Pipeline:
        return Pipeline(self.inputs, [*self.tasks, (name, fn, uses or ((self.tasks[-1][0],) if self.tasks else tuple(self.inputs)))], self.writes)

    def __add__(self, other: Pipeline) -> Pipeline:
        return Pipeline(self.inputs | other.inputs, self.tasks + other.tasks, self.writes | other.writes)

    def run(self) -> dict[str, object]:
        made = dict(self.inputs)
        for name, fn, uses in self.tasks:
            made[name] = fn(*[made[u] for u in uses])
            if name in self.writes and isinstance(made[name], RasterFrame):
                made[name].save(self.writes[name])
        return made

    def describe(self) -> str:
        return "\n".join(f"{', '.join(uses)} -> {name}" for name, _, uses in self.tasks)


def scene_cube(df: DataFrame, bands: list[str], sensor: str, gains: dict[str, float], biases: dict[str, float], latitude: float, qa: str | None = None, qa_sensor: str = "l8-c1") -> DataFrame:
    """Numbers of one or many scenes (time, row, col, bands, angles in degrees) to masked, BRDF-normalised reflectance of Landsat 8:
    calibration and SREM, BRDF, bandpass, quality codes below shadow.  One chain of expressions, no shuffle."""
    out = radiometry.dn_to_sr(df, bands, sensor, gains, biases)
    out = radiometry.norm_brdf(out, bands, latitude=latitude)
    platform = next((p for p in ("s2a", "s2b", "l5", "l7") if sensor.startswith(p)), None)
    out = index.bandpass(out, platform, bands) if platform else out
    if qa:
        out = masks.keep_where(out, bands, masks.qa_codes(qa, qa_sensor, confidence="maybe") < 2).drop(qa)
    return out.withColumns({b: F.round(F.col(b), 6) for b in bands})
