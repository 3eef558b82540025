"""Climatology from a stream of an archive's files, with the last days of each tile as its only state.

A batch of the source holds whole source days, of all years and cells, in the order of the year. Of each
tile of cells the state keeps the values of the last 2 * delta + 1 days, as one slot a day of the year; a
target's statistics are emitted in the batch that brings a day at or after the target's last one, and
the day's slot is overwritten later. So the state's size depends on window, years and cells only, however
long the stream is, and no row is ever copied for the windows that hold it.

Defined results: cells and days without a sample have no row; days without a file count as missing; a
target whose last day the archive doesn't reach isn't emitted; a stream that is started again goes on
from its checkpoint. Files that come for days that are past aren't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators.climatology import DELTA, SEASON, check_targets
from meridian.sources.grid_source import stream_archive

OUT = "doy int, cell int, n long, clim_mean double, p90 double"
STATE = "last int, cells binary, slots binary"


class Ring:
    """The last days of one tile: values by (day of the year modulo size, year, cell), NaN where missing."""

    def __init__(self, size: int, years: int, state: tuple | None, first: int):
        self.size, self.years = size, years
        if state is None:
            self.last, self.cells, self.slots = first - 1, np.zeros(0, np.int32), np.full((size, years, 0), np.nan)
        else:
            self.last, self.cells = state[0], np.frombuffer(state[1], np.int32)
            self.slots = np.frombuffer(state[2], np.float64).reshape(size, years, len(self.cells)).copy()

    def state(self) -> tuple:
        return self.last, self.cells.tobytes(), self.slots.tobytes()

    def widen(self, cells: np.ndarray) -> None:
        every = np.union1d(self.cells, cells).astype(np.int32)
        if len(every) > len(self.cells):
            slots = np.full((self.size, self.years, len(every)), np.nan)
            slots[:, :, np.searchsorted(every, self.cells)] = self.slots
            self.cells, self.slots = every, slots

    def take(self, day: int, year: np.ndarray, cell: np.ndarray, v: np.ndarray) -> None:
        """The values of the next day, in place of those of ``size`` days ago."""
        slot = self.slots[day % self.size]
        slot[:] = np.nan
        slot[year, np.searchsorted(self.cells, cell)] = v
        self.last = day

    def statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells that have values in the ring, their number, mean and 90th percentile."""
        window = self.slots.reshape(self.size * self.years, -1)
        n = (~np.isnan(window)).sum(axis=0)
        has = n > 0
        window = window[:, has]
        mean, p90 = (np.nanmean(window, axis=0), np.nanquantile(window, 0.9, axis=0, method="linear")) if has.any() else (np.zeros(0), np.zeros(0))
        return self.cells[has], n[has], mean, p90


def _emit(years: tuple[int, int], targets: tuple[int, int], delta: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        ring = Ring(2 * delta + 1, years[1] - years[0] + 1, state.get if state.exists else None, targets[0] - delta)
        ring.widen(rows["cell"].to_numpy())
        doy = rows["doy"].to_numpy()
        order = np.argsort(doy, kind="stable")
        doy, year, cell, v = doy[order], rows["year"].to_numpy()[order] - years[0], rows["cell"].to_numpy()[order], rows["v"].to_numpy(dtype=np.float64)[order]
        for day in range(ring.last + 1, int(doy[-1]) + 1 if len(doy) else 0):
            at = slice(*np.searchsorted(doy, [day, day + 1]))
            ring.take(day, year[at], cell[at], v[at])
            if targets[0] <= day - delta <= targets[1]:
                cells, n, mean, p90 = ring.statistics()
                yield pd.DataFrame({"doy": np.full(len(cells), day - delta, np.int32), "cell": cells, "n": n.astype(np.int64), "clim_mean": mean, "p90": p90})
        state.update(ring.state())

    return run


def ring_climatology(rows: DataFrame, years: tuple[int, int], targets: tuple[int, int] = SEASON, delta: int = DELTA, tile_cells: int = 256) -> DataFrame:
    """A stream of (cell, year, doy, v), whole days at a time, to doy, cell, n, clim_mean, p90; append mode."""
    check_targets(targets, delta)
    inside = rows.where(F.col("doy").between(targets[0] - delta, targets[1] + delta) & F.col("year").between(*years))
    tiled = inside.select(F.expr(f"cell div {tile_cells}").cast("int").alias("tile"), "cell", "year", "doy", F.col("v").cast("double").alias("v"))
    return tiled.groupBy("tile").applyInPandasWithState(_emit(years, targets, delta), OUT, STATE, "append", "NoTimeout")


def archive_climatology(spark: SparkSession, path: str, n_lon: int, years: tuple[int, int], targets: tuple[int, int] = SEASON, delta: int = DELTA, variable: str = "data", tile_cells: int = 256, **options) -> DataFrame:
    """The statistics of an archive of daily files as a stream: its files, and those that are still to come."""
    rows = stream_archive(spark, path, [variable], first_day=targets[0] - delta, last_day=targets[1] + delta, **options)
    cells = rows.select((F.col("lat_idx") * n_lon + F.col("lon_idx")).cast("int").alias("cell"), "year", "doy", F.col(variable).alias("v"))
    return ring_climatology(cells, years, targets, delta, tile_cells)


def run_archive(spark: SparkSession, path: str, folder: str, n_lon: int, years: tuple[int, int], targets: tuple[int, int] = SEASON, **options) -> DataFrame:
    """Takes what the archive has now and appends its statistics to ``folder``/out; goes on from where the last call ended."""
    stream = archive_climatology(spark, path, n_lon, years, targets, **options)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
