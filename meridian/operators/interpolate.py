"""Statistics at anchor days, and linear interpolation in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .climatology import DELTA, SEASON, in_windows, statistics


def anchors(targets: tuple[int, int], stride: int) -> list[int]:
    """Every ``stride``-th day from the first, and the last."""
    return [*range(targets[0], targets[1], stride), targets[1]]


def anchored_climatology(obs: DataFrame, stride: int, targets: tuple[int, int] = SEASON, delta: int = DELTA) -> DataFrame:
    """doy, cell, clim_mean, p90: exact at the anchors; elsewhere null unless both neighbours are present."""
    b, e = targets
    days = anchors(targets, stride)
    at = statistics(in_windows(obs, targets, delta, days, by_cell=True)).select("doy", "cell", "clim_mean", "p90")
    left = F.when(F.col("doy") == e, e).otherwise(b + F.floor((F.col("doy") - b) / stride) * stride).cast("int")
    rows = at.select("cell").distinct().select("cell", F.explode(F.sequence(F.lit(b), F.lit(e))).alias("doy")).withColumn("l", left)
    rows = rows.withColumn("r", F.when(F.col("doy") == F.col("l"), F.col("l")).otherwise(F.least(F.col("l") + stride, F.lit(e))))
    side = lambda s: at.select("cell", F.col("doy").alias(s), F.col("clim_mean").alias(f"{s}_mean"), F.col("p90").alias(f"{s}_p90"))
    rows = rows.join(side("l"), ["cell", "l"], "left").join(side("r"), ["cell", "r"], "left")
    t = F.when(F.col("r") > F.col("l"), (F.col("doy") - F.col("l")) / (F.col("r") - F.col("l"))).otherwise(0.0)
    between = lambda c: F.round(F.col(f"l_{c}") + (F.col(f"r_{c}") - F.col(f"l_{c}")) * t, 6)
    return rows.select("doy", "cell", between("mean").alias("clim_mean"), between("p90").alias("p90"))
