"""Exact day-of-year statistics over a centred window of days and all years.

The window is an expansion of each observation to the at most 2 * delta + 1 target days that it
counts for, so the work is one equi-aggregation keyed by (day, cell): no range join. Observations
(one a cell, year and day) are dealt by cell before they are expanded: a percentile can't be reduced
on the map side, so the shuffle would carry every row 2 * delta + 1 times. Targets keep delta days
of distance from the ends of the year, unless the windows are circular: then December's last days count
for January's first ones and the other way round, of all years alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DELTA = 5
SEASON = (152, 243)


YEAR = 365


def check_targets(targets: tuple[int, int], delta: int = DELTA, circular: bool = False) -> tuple[int, int]:
    b, e = targets
    if circular:
        if not (1 <= b <= e <= YEAR and 2 * delta < YEAR):
            raise ValueError(f"circular targets must be an ascending pair within 1..{YEAR}, and windows shorter than a year")
        return targets
    if not (1 + delta <= b <= e <= 365 - delta):
        raise ValueError(f"targets must be an ascending pair within {1 + delta}..{365 - delta}")
    return targets


def in_windows(obs: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA, days: list[int] | None = None, by_cell: bool = False, circular: bool = False) -> DataFrame:
    """obs with ``target``: one row for each target day (of ``days`` only, if given) whose window holds the observation.

    ``by_cell`` deals the rows by cell first; an aggregation by target and cell then needs no other
    exchange. It is for observations of which a cell has a bounded number.
    """
    b, e = check_targets(targets, delta, circular)
    doy = F.col("doy")
    # days within delta of the targets, around the year's end where windows are circular
    near = F.pmod(doy - (b - delta), F.lit(YEAR)) <= e - b + 2 * delta if circular else doy.between(b - delta, e + delta)
    rows = obs.where(near)
    if by_cell:
        rows = rows.repartition("cell")
    if circular:
        around = F.transform(F.sequence(doy - delta, doy + delta), lambda t: F.pmod(t - 1, F.lit(YEAR)) + 1)
        found = F.filter(around, lambda t: t.between(b, e))
    else:
        found = F.sequence(F.greatest(F.lit(b), doy - delta), F.least(F.lit(e), doy + delta))
    if days is not None:
        found = F.filter(found, lambda t: t.isin(days))
    return rows.withColumn("target", F.explode(found))


def mean_of(v: str = "v") -> Column:
    return F.sum(v).cast("double") / F.count(v)


def p90_of(v: str = "v") -> Column:
    """Linear interpolation between order statistics at rank 0.9 * (n - 1)."""
    return F.round(F.percentile(F.col(v).cast("double"), F.lit(0.9)), 6)


def statistics(windowed: DataFrame, zero_mask: tuple[int, int] | None = None) -> DataFrame:
    """doy, cell, n, clim_mean, p90 of (target, cell, v) rows.

    ``zero_mask`` is (first year, delta): where the window's first slot (its first day in the first
    year) is present and zero, mean and percentile are zero.
    """
    mean, p90, extra = mean_of(), p90_of(), []
    if zero_mask:
        first_year, delta = zero_mask
        extra = [F.coalesce(F.max(F.when((F.col("doy") == F.col("target") - delta) & (F.col("year") == first_year), F.col("v") == 0)), F.lit(False)).alias("masked")]
    out = windowed.groupBy("target", "cell").agg(F.count("v").alias("n"), mean.alias("clim_mean"), p90.alias("p90"), *extra)
    value = (lambda c: F.when(F.col("masked"), 0.0).otherwise(F.col(c)).alias(c)) if zero_mask else F.col
    return out.select(F.col("target").alias("doy"), "cell", "n", value("clim_mean"), value("p90"))


def climatology(obs: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA, zero_mask_year: int | None = None, circular: bool = False) -> DataFrame:
    """doy, cell, n, clim_mean, p90 of observations, one row a cell, year and day (``obs.daily``)."""
    if circular and zero_mask_year is not None:
        raise ValueError("a circular window has no first slot to mask by")
    return statistics(in_windows(obs, targets, delta, by_cell=True, circular=circular), (zero_mask_year, delta) if zero_mask_year is not None else None)


def by_selection(obs: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA) -> DataFrame:
    """The percentile from the k-th elements of each window's sorted values."""
    held = in_windows(obs.where("v is not null"), targets, delta, by_cell=True).groupBy("target", "cell").agg(F.array_sort(F.collect_list(F.col("v").cast("double"))).alias("x"))
    rank = 0.9 * (F.size("x") - 1)
    at = F.floor(rank).cast("int")
    low, high = F.element_at("x", at + 1), F.element_at("x", F.least(at + 2, F.size("x")))
    return held.select(F.col("target").alias("doy"), "cell", F.size("x").cast("long").alias("n"), low.alias("kth"), F.round(low + (rank - at) * (high - low), 6).alias("p90"))


def preaggregated_mean(obs: DataFrame, cells_days: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA) -> DataFrame:
    """Means only: sums per cell and day, then a running sum over the days of each cell.

    ``cells_days`` has every (cell, doy) from targets[0] - delta to targets[1] + delta.
    """
    sums = obs.where(F.col("doy").between(targets[0] - delta, targets[1] + delta)).groupBy("cell", "doy").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    w = W.partitionBy("cell").orderBy("doy").rangeBetween(-delta, delta)
    dense = cells_days.join(sums, ["cell", "doy"], "left").select("cell", "doy", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"))
    return dense.where(F.col("doy").between(*targets) & (F.col("n") > 0)).select("doy", "cell", "n", (F.col("s").cast("double") / F.col("n")).alias("clim_mean"))


def by_time_window(obs: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA) -> DataFrame:
    """The same windows as sliding event-time windows over a year without leap day (2001)."""
    rows = obs.where(F.col("doy").between(targets[0] - delta, targets[1] + delta)).withColumn("ts", F.date_add(F.lit("2001-01-01").cast("date"), F.col("doy") - 1).cast("timestamp"))
    out = rows.groupBy(F.window("ts", f"{2 * delta + 1} days", "1 day").alias("w"), "cell").agg(F.count("v").alias("n"), mean_of().alias("clim_mean"), p90_of().alias("p90"))
    out = out.withColumn("doy", (F.dayofyear("w.start") + delta).cast("int"))
    return out.where(F.col("doy").between(*targets)).select("doy", "cell", "n", "clim_mean", "p90")


def dense(result: DataFrame, spine: DataFrame) -> DataFrame:
    """All (cell, doy) of the spine; where no sample is, n is 0 and the statistics are null."""
    return spine.join(result, ["doy", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
