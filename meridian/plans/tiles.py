"""Full-resolution grids by tile: one numpy block of (day, year, cell) per tile instead of expanded rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators.climatology import DELTA, SEASON, check_targets
from meridian.operators.estimators import BINS, LOW, WIDTH, bin_of


def _tile(targets: tuple[int, int], delta: int, years: tuple[int, int], zero_mask_year: int | None):
    first = None if zero_mask_year is None else zero_mask_year - years[0]

    def run(table: pa.Table) -> pa.Table:
        cell, year, doy = (table.column(c).to_numpy() for c in ("cell", "year", "doy"))
        v = table.column("v").to_numpy()  # nulls as NaN
        cells, at = np.unique(cell, return_inverse=True)
        shape = (targets[1] - targets[0] + 2 * delta + 1, years[1] - years[0] + 1, len(cells))
        cube, seen = np.full(shape, np.nan), np.zeros(shape, dtype=bool)
        place = (doy - targets[0] + delta, year - years[0], at)
        cube[place], seen[place] = v, True
        out = {c: [] for c in ("doy", "cell", "n", "clim_mean", "p90")}
        for t in range(targets[0], targets[1] + 1):
            days = slice(t - targets[0], t - targets[0] + 2 * delta + 1)
            window = cube[days].reshape(-1, len(cells))
            n = (~np.isnan(window)).sum(axis=0)
            mean, p90 = np.full(len(cells), np.nan), np.full(len(cells), np.nan)
            has = n > 0
            mean[has], p90[has] = np.nanmean(window[:, has], axis=0), np.nanquantile(window[:, has], 0.9, axis=0, method="linear")
            if first is not None and 0 <= first < shape[1]:
                masked = cube[days.start, first] == 0
                mean[masked] = p90[masked] = 0.0
            rows = seen[days].any(axis=(0, 1))
            for c, x in (("doy", np.full(len(cells), t)), ("cell", cells), ("n", n), ("clim_mean", mean), ("p90", p90)):
                out[c].append(x[rows])
        types = {"doy": pa.int32(), "cell": pa.int32(), "n": pa.int64(), "clim_mean": pa.float64(), "p90": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(x), types[c], from_pandas=True) for c, x in out.items()})

    return run


def _prefix_sums(targets: tuple[int, int], delta: int, bins: int, low: float, width: float):
    """Counts by day and bin of a tile's cells are summed along the days; a window is a difference of two sums."""
    days = targets[1] - targets[0] + 2 * delta + 1

    def run(table: pa.Table) -> pa.Table:
        cell, doy, bin_, c = (table.column(k).to_numpy() for k in ("cell", "doy", "bin", "c"))
        cells, at = np.unique(cell, return_inverse=True)
        out = {k: [] for k in ("doy", "cell", "n", "p90")}
        for i, one in enumerate(cells):
            mine = at == i
            sums = np.zeros((days + 1, bins), dtype=np.int64)
            np.add.at(sums, (doy[mine] - targets[0] + delta + 1, bin_[mine]), c[mine])
            sums = np.cumsum(sums, axis=0)
            upto = np.cumsum(sums[2 * delta + 1 :] - sums[: days - 2 * delta], axis=1)  # (target, bin)
            n = upto[:, -1]
            has = np.flatnonzero(n)
            rank = 0.9 * (n[has] - 1)
            found = (upto[has] <= np.floor(rank)[:, None]).sum(axis=1)  # the bin that holds the rank
            count = upto[has, found] - np.where(found > 0, upto[has, found - 1], 0)
            before = upto[has, found] - count
            part = np.where(n[has] == 1, 0.5, np.clip((rank - before) / count, 0, 1))
            for k, x in (("doy", has + targets[0]), ("cell", np.full(len(has), one)), ("n", n[has]), ("p90", low + (found + part) * width)):
                out[k].append(x)
        types = {"doy": pa.int32(), "cell": pa.int32(), "n": pa.int64(), "p90": pa.float64()}
        return pa.table({k: pa.array(np.concatenate(x), types[k]) for k, x in out.items()})

    return run


def prefix_histogram(obs: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA, tile_cells: int = 256) -> DataFrame:
    """doy, cell, n, p90, as ``estimators.fast_histogram`` gives them, without a copy of any count for the windows that hold it."""
    check_targets(targets, delta)
    inside = obs.where(F.col("v").isNotNull() & F.col("doy").between(targets[0] - delta, targets[1] + delta))
    counts = inside.groupBy("cell", "doy", bin_of().alias("bin")).agg(F.count("*").alias("c"))
    tiled = counts.withColumn("tile", F.expr(f"cell div {tile_cells}").cast("int"))
    found = tiled.groupBy("tile").applyInArrow(_prefix_sums(targets, delta, BINS, LOW, WIDTH), "doy int, cell int, n long, p90 double")
    return found.withColumn("p90", F.round("p90", 6))


def _collected(targets: tuple[int, int], delta: int, most: int | None):
    """Of each cell the values in order, once for all targets: a window's running counts along them lead to the values of its rank."""

    def run(table: pa.Table) -> pa.Table:
        cell, doy, v, bin_, c = (table.column(k).to_numpy() for k in ("cell", "doy", "v", "bin", "c"))
        order = np.lexsort((v, cell))
        cell, doy, v, bin_, c = cell[order], doy[order], v[order], bin_[order], c[order]
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        out = {k: [] for k in ("doy", "cell", "n", "p90")}
        for a, b in zip(starts, np.append(starts[1:], len(cell)), strict=True):
            days, values, bins, counts = doy[a:b], v[a:b], bin_[a:b], c[a:b]
            for t in range(targets[0], targets[1] + 1):
                upto = np.cumsum(np.where(np.abs(days - t) <= delta, counts, 0))
                n = int(upto[-1])
                if not n:
                    continue
                rank = 0.9 * (n - 1)
                low = int(rank)
                i, j = np.searchsorted(upto, [low, min(low + 1, n - 1)], side="right")
                p90 = values[i] + (rank - low) * (values[j] - values[i])
                if most is not None:
                    first, last = np.searchsorted(bins, bins[i]), np.searchsorted(bins, bins[j], side="right")
                    if upto[last - 1] - (upto[first - 1] if first else 0) > most:
                        p90 = LOW + (bins[i] + 0.5) * WIDTH
                for k, x in (("doy", t), ("cell", cell[a]), ("n", n), ("p90", p90)):
                    out[k].append(x)
        types = {"doy": pa.int32(), "cell": pa.int32(), "n": pa.int64(), "p90": pa.float64()}
        return pa.table({k: pa.array(x, types[k]) for k, x in out.items()})

    return run


def collected_histogram(obs: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA, most: int | None = None, tile_cells: int = 64) -> DataFrame:
    """doy, cell, n, p90, as ``estimators.fixed_collect`` gives them, without a copy of any value for the windows that hold it.

    Equal values of a cell's day go as one with their count; a tile's distinct ones are held by a task.
    """
    check_targets(targets, delta)
    inside = obs.where(F.col("v").isNotNull() & F.col("doy").between(targets[0] - delta, targets[1] + delta))
    daily = inside.groupBy("cell", "doy", F.col("v").cast("double").alias("v")).agg(F.count("*").alias("c"))
    tiled = daily.select(F.expr(f"cell div {tile_cells}").cast("int").alias("tile"), "cell", "doy", "v", bin_of().alias("bin"), "c")
    found = tiled.groupBy("tile").applyInArrow(_collected(targets, delta, most), "doy int, cell int, n long, p90 double")
    return found.withColumn("p90", F.round("p90", 6))


def tiled_climatology(obs: DataFrame, years: tuple[int, int], targets: tuple[int, int] = SEASON, delta: int = DELTA, tile_cells: int = 256, zero_mask_year: int | None = None) -> DataFrame:
    """doy, cell, n, clim_mean, p90, as ``climatology`` gives them but for rounding; a task holds one tile at a time (256 cells x 102 days x 30 years: 6 MB).

    Observations stored by tile (``sources.store``) have theirs, and aren't exchanged.
    """
    if "tile" in obs.columns:
        kept = obs.where(F.col("doy").between(targets[0] - delta, targets[1] + delta) & F.col("year").between(*years)).select("tile", "cell", "year", "doy", F.col("v").cast("double").alias("v"))
        return kept.groupBy("tile").applyInArrow(_tile(targets, delta, years, zero_mask_year), "doy int, cell int, n long, clim_mean double, p90 double")
    rows = obs.where(F.col("doy").between(targets[0] - delta, targets[1] + delta) & F.col("year").between(*years))
    rows = rows.select(F.expr(f"cell div {tile_cells}").cast("int").alias("tile"), "cell", "year", "doy", F.col("v").cast("double").alias("v"))
    return rows.groupBy("tile").applyInArrow(_tile(targets, delta, years, zero_mask_year), "doy int, cell int, n long, clim_mean double, p90 double")
