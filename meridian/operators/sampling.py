"""Monte-Carlo estimators: seeded sample plans as rows, joined to the observations.

A plan has one row per draw (multiplicity matters): target ``doy``, ``unit`` (a block of cells, one
cell, or 0 for all), the ``year`` index and the window ``offset`` (0 .. 2 * delta). Plans are made by
numpy in Arrow batches from rows of (doy, unit, year, rep), so they grow with the grid and stay
distributed; the join keys are (unit, year, day).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .climatology import DELTA, SEASON, statistics

U = np.uint64
# fixed values of the generators: seeds and multipliers
GOLDEN = U(0x9E3779B97F4A7C15)
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
PACKED_SEED = U(0xD1B54A32D192ED03)
LCG_MUL, LCG_ADD = 6364136223846793005, 1442695040888963407
YEAR_STEP, REP_STEP, DAY_SHIFT, BLOCK = 131071, 65537, 4099, 256
MOST_DRAWS, SLOTS_PER_YEAR_PLAN = 120, 30


def _scramble(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * MIX1
    z = (z ^ (z >> U(27))) * MIX2
    return z ^ (z >> U(31))


def draws(s0: np.ndarray, s1: np.ndarray, n: int) -> np.ndarray:
    """The next ``n`` values of each xorshift128+ state, (n, states)."""
    out = np.empty((n, len(s0)), dtype=U)
    for i in range(n):
        x, y = s0, s1
        x = x ^ (x << U(23))
        s0, s1 = y, x ^ y ^ (x >> U(18)) ^ (y >> U(5))
        out[i] = s1 + s0
    return out


def cell_draws(index: np.ndarray, day: np.ndarray, n: int = 1, warm_up: int = 4) -> np.ndarray:
    """Draws of generators seeded by an index and a day."""
    z = _scramble((index.astype(np.int64) + 1).astype(U) * GOLDEN)
    return draws(z, z ^ (day.astype(U) * GOLDEN), warm_up + n)[warm_up:]


def packed_draws(year: np.ndarray, doy: np.ndarray, n: int) -> np.ndarray:
    """Draws of generators seeded by a year's index and a day-of-year, without warm-up."""
    seed = PACKED_SEED ^ (doy.astype(U) * GOLDEN) ^ ((year + 1).astype(U) * MIX1)
    return draws(_scramble(seed + GOLDEN), _scramble(seed + GOLDEN + GOLDEN), n)


def stratum(draw: np.ndarray, rep: np.ndarray, parts: int, size: int) -> np.ndarray:
    """A position within the rep-th of ``parts`` even strata of range(size)."""
    low = rep * size // parts
    high = np.minimum(np.maximum((rep + 1) * size // parts, low + 1), size)
    return low + (draw % (high - low).astype(U)).astype(np.int64)


def draws_per_year(k: int, n_years: int, mode: str = "", delta: int = DELTA) -> int:
    """k is cut to 1..120 and to a whole number of draws in each year; packed draws are distinct offsets, so no more than the window has."""
    each = max(1, min(max(k, 0), MOST_DRAWS) // n_years)
    return min(each, 2 * delta + 1) if mode == "packed" else each


def settled_mode(mode: str, k: int, n_years: int) -> str:
    """Fewer draws than years are strata of all slots."""
    return "source_flat" if mode == "source" and k < n_years else mode


def plan_offsets(mode: str, doy, unit, year, rep, *, first: int, n_years: int, k: int, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """(year index, window offset) of each draw (doy, unit, year, rep).

    Modes: ``source`` (a stratum of the window for each rep), ``source_flat`` (strata of all slots, day by
    day; rep numbers the draw), ``block`` (uniform offset), ``independent`` (uniform slot; rep numbers
    the draw), ``packed`` (distinct offsets), ``consistent`` (one list for all days and cells).
    """
    doy, unit, year, rep = (np.asarray(x, dtype=np.int64) for x in (doy, unit, year, rep))
    size = 2 * delta + 1
    each = draws_per_year(k, n_years, mode, delta)
    if mode == "source":
        d = cell_draws(unit + YEAR_STEP * year + REP_STEP * rep, doy - first + DAY_SHIFT)[0]
        return year, stratum(d, rep, each, size)
    if mode == "source_flat":
        d = cell_draws(unit + REP_STEP * rep, doy - first + DAY_SHIFT)[0]
        slot = stratum(d, rep, k, size * n_years)
        return slot % n_years, slot // n_years
    if mode == "block":
        d = cell_draws(unit + REP_STEP * rep + YEAR_STEP * year, doy)[0]
        return year, (d % U(size)).astype(np.int64)
    if mode == "independent":
        keys, at = np.unique(np.stack([unit, doy]), axis=1, return_inverse=True)
        slot = (cell_draws(keys[0], keys[1], int(rep.max()) + 1)[rep, at.ravel()] % U(size * n_years)).astype(np.int64)
        return slot // size, slot % size
    if mode == "packed":
        keys, at = np.unique(np.stack([year, doy]), axis=1, return_inverse=True)
        wanted = (packed_draws(keys[0], keys[1], each) % U(size)).astype(np.int64)
        taken, found = np.zeros((size, keys.shape[1]), dtype=bool), np.empty_like(wanted)
        column = np.arange(keys.shape[1])
        for j in range(each):  # the next free offset, around the window
            pos = wanted[j]
            for _ in range(size):
                pos = np.where(taken[pos, column], (pos + 1) % size, pos)
            taken[pos, column], found[j] = True, pos
        return year, found[rep, at.ravel()]
    if mode == "consistent":
        state, listed = int(GOLDEN), []
        for _ in range(n_years * each):
            state = (state * LCG_MUL + LCG_ADD) % 2**64
            listed.append(state % size)
        return year, np.array(listed)[year * each + rep]
    raise ValueError(f"unknown mode {mode}")


def _fill(mode: str, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doy, unit, year, rep = (b.column(i).to_numpy() for i in range(4))
                y, off = plan_offsets(mode, doy, unit, year, rep, **options)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(y.astype(np.int32)), pa.array((doy + off - options["delta"]).astype(np.int32))], names=["target", "unit", "year_idx", "doy"])

    return run


def sample_plan(spark: SparkSession, units: DataFrame, mode: str, k: int, n_years: int, targets: tuple[int, int] = SEASON, delta: int = DELTA) -> DataFrame:
    """(target, unit, year_idx, doy) rows of all draws; ``units`` has the distinct units (column unit)."""
    mode = settled_mode(mode, k, n_years)
    each = draws_per_year(k, n_years, mode, delta)
    flat = mode in ("source_flat", "independent")
    k = max(1, min(k, MOST_DRAWS)) if mode == "source_flat" else each * n_years
    days = F.explode(F.sequence(F.lit(targets[0]), F.lit(targets[1])))
    rows = units.select(days.alias("target"), F.col("unit").cast("int").alias("unit"))
    rows = rows.withColumn("year_idx", F.explode(F.sequence(F.lit(0), F.lit(0 if flat else n_years - 1)))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit((k if flat else each) - 1))))
    options = {"first": targets[0], "n_years": n_years, "k": k, "delta": delta}
    return rows.mapInArrow(_fill(mode, options), "target int, unit int, year_idx int, doy int")


def unit_of(mode: str, per_cell: bool, band_start: int = 0):
    """The unit that a cell shares its draws with: its block's first cell, itself, or all."""
    if mode in ("packed", "consistent"):
        return F.lit(0)
    if per_cell or mode == "independent":
        return F.col("cell")
    return (F.lit(band_start) + BLOCK * F.floor((F.col("cell") - band_start) / BLOCK)).cast("int")


def sampled_climatology(obs: DataFrame, mode: str, k: int, years: tuple[int, int], targets: tuple[int, int] = SEASON, delta: int = DELTA, per_cell: bool = False, exact_mean: bool = False, band_start: int = 0) -> DataFrame:
    """doy, cell, n, clim_mean, p90 of the sampled observations; with ``exact_mean`` the mean is that of all.

    Where all cells share their draws the plan is small (at most 365 days x 120 draws) and goes to the
    observations by broadcast; those of other days are dropped where they are read. Observations stored
    by day (``sources.store``) are pruned when the plan is there: folders of other days aren't read.
    """
    from .climatology import climatology

    mode = settled_mode(mode, k, years[1] - years[0] + 1)
    keyed = obs.where(F.col("year").between(*years)).withColumn("unit", unit_of(mode, per_cell, band_start))
    units = obs.sparkSession.range(1).select(F.lit(0).alias("unit")) if mode in ("packed", "consistent") else keyed.select("unit").distinct()
    plan = sample_plan(obs.sparkSession, units, mode, k, years[1] - years[0] + 1, targets, delta)
    # the condition, which always holds, tells Spark that the plan selects: it prunes stored days by it
    plan = plan.withColumn("year", F.col("year_idx") + years[0]).where(F.col("year") >= years[0])
    if mode in ("packed", "consistent"):
        plan = F.broadcast(plan)
    if "day" in obs.columns:  # stored by day
        plan = plan.select("target", "unit", (F.col("year") * 1000 + F.col("doy")).cast("int").alias("day"))
    out = statistics(keyed.join(plan, ["unit", "day"] if "day" in obs.columns else ["unit", "year", "doy"]))
    if exact_mean:
        whole = climatology(obs, targets, delta).select("doy", "cell", F.col("clim_mean").alias("whole"))
        out = whole.join(out, ["doy", "cell"], "left").select("doy", "cell", F.coalesce("n", F.lit(0)).alias("n"), F.col("whole").alias("clim_mean"), "p90")
    return out
