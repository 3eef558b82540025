"""One entry that takes what affects results and picks the plan that gives them.

The settings' precedence: a sampler with draws, then the estimators on bins that keep the rank's values,
then plain bins, then exact statistics; anchors and masks go with exact statistics alone. Where one
result has several plans, statistics of the observations decide: what the windows' copies would take in
the shuffle against what a tile's cube takes in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators import climatology as clim
from meridian.operators import estimators as est
from meridian.operators import interpolate, sampling

from .tiles import collected_histogram, prefix_histogram, tiled_climatology

ROW_BYTES = 32  # of an expanded observation
MOST_EXPANDED = 8 << 30  # bytes of a run's expanded observations
TILE_BYTES = 64 << 20  # of a tile's cube


@dataclass(frozen=True)
class Settings:
    """What affects results: base period, targets and window, estimator and sampler, anchors, mask."""

    years: tuple[int, int]
    targets: tuple[int, int] = clim.SEASON
    delta: int = clim.DELTA
    estimator: str = "exact"  # or fixed_collect, fast_histogram
    sampler: str | None = None  # one of sampling's modes
    draws: int = 0
    per_cell: bool = False
    exact_mean: bool = False
    anchor_stride: int = 0
    zero_mask: bool = False
    circular: bool = False

    def checked(self) -> Settings:
        clim.check_targets(self.targets, self.delta, self.circular)
        if self.estimator not in ("exact", "fixed_collect", "fast_histogram"):
            raise ValueError(f"unknown estimator {self.estimator}")
        if self.draws < 0 or self.anchor_stride < 0 or self.years[0] > self.years[1]:
            raise ValueError("draws and anchor_stride are not negative, years ascend")
        special = [name for name, on in (("anchor_stride", self.anchor_stride > 1), ("zero_mask", self.zero_mask), ("circular", self.circular)) if on]
        if special and (self.estimator != "exact" or self.sampler and self.draws):
            raise ValueError(f"{special[0]} goes with exact statistics")
        if len(special) > 1:
            raise ValueError(f"{special[0]} doesn't go with {special[1]}")
        return self


@dataclass(frozen=True)
class Plan:
    """``name`` of the plan, why it was picked, and its tile's size where it has tiles."""

    name: str
    reason: str
    tile_cells: int = 0


def estimated_bytes(obs: DataFrame) -> int:
    """The optimizer's estimate of the observations' size."""
    return int(str(obs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def choose(settings: Settings, size: int) -> Plan:
    """The plan for observations of about ``size`` bytes."""
    s = settings.checked()
    if s.sampler and s.draws:
        return Plan("sampled", "draws were asked for")
    days = s.targets[1] - s.targets[0] + 2 * s.delta + 1
    cube = days * (s.years[1] - s.years[0] + 1) * 8  # bytes a cell
    cells = max(1, min(4096, TILE_BYTES // cube))
    if s.estimator == "fixed_collect":
        return Plan("collected_histogram", "the rank's bins and their values were asked for: values in order, running counts", 64)
    if s.estimator == "fast_histogram":
        sums = (days + 1) * est.BINS * 8  # a cell's; one cell is worked on at a time
        return Plan("prefix_histogram", "bins were asked for: windows are differences of running sums", max(1, min(256, TILE_BYTES // sums * 16)))
    if s.anchor_stride > 1:
        return Plan("anchored", "anchors were asked for")
    expanded = size * (2 * s.delta + 1)
    if s.circular or expanded <= MOST_EXPANDED:
        return Plan("expanded", "windows are circular" if s.circular else f"copies for the windows take about {expanded} bytes")
    return Plan("tiled", f"copies for the windows would take about {expanded} bytes", cells)


def run(obs: DataFrame, settings: Settings, plan: Plan) -> DataFrame:
    """doy, cell and the statistics of the settings by the given plan; observations are one a cell, year and day, but for estimators on bins."""
    s = settings.checked()
    rows = obs.where(F.col("year").between(*s.years))
    mask = s.years[0] if s.zero_mask else None
    if plan.name == "sampled":
        return sampling.sampled_climatology(rows, s.sampler, s.draws, s.years, s.targets, s.delta, per_cell=s.per_cell, exact_mean=s.exact_mean)
    if plan.name == "collected_histogram":
        return collected_histogram(rows, s.targets, s.delta, tile_cells=plan.tile_cells)
    if plan.name == "prefix_histogram":
        return prefix_histogram(rows, s.targets, s.delta, plan.tile_cells)
    if plan.name == "anchored":
        return interpolate.anchored_climatology(rows, s.anchor_stride, s.targets, s.delta)
    if plan.name == "tiled":
        return tiled_climatology(rows, s.years, s.targets, s.delta, plan.tile_cells, mask)
    if plan.name == "expanded":
        return clim.climatology(rows, s.targets, s.delta, mask, s.circular)
    raise ValueError(f"unknown plan {plan.name}")


def climatology_of(obs: DataFrame, settings: Settings) -> DataFrame:
    """The statistics that the settings ask for, by the plan that suits the observations."""
    return run(obs, settings, choose(settings, estimated_bytes(obs)))
