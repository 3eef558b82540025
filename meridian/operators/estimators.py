"""Percentile estimators on fixed bins. Histograms add up, so windows merge counts per cell and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .climatology import DELTA, SEASON, in_windows

# fixed values: number of bins and their range
BINS, LOW, HIGH = 512, -3.0, 45.0
WIDTH = (HIGH - LOW) / BINS
MOST_COLLECTED = 256


def bin_of(v: str = "v"):
    """The bin, values outside the range in the first or last."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col(v) - LOW) / WIDTH))).cast("int")


def histogram(obs: DataFrame, *keys: str) -> DataFrame:
    """Counts per key and bin, and the running count."""
    counts = obs.where("v is not null").groupBy(*keys, bin_of().alias("bin")).agg(F.count("*").alias("cnt"))
    return counts.withColumn("cumulative", F.sum("cnt").over(W.partitionBy(*keys).orderBy("bin")))


def _window_bins(obs: DataFrame, targets, delta) -> DataFrame:
    """Bins of each window with counts, running counts before, and the window's total and rank."""
    daily = obs.where("v is not null").groupBy("cell", "doy", bin_of().alias("bin")).agg(F.count("*").alias("c"))
    bins = in_windows(daily, targets, delta).groupBy("target", "cell", "bin").agg(F.sum("c").alias("cnt"))
    key = W.partitionBy("target", "cell")
    bins = bins.withColumn("before", F.sum("cnt").over(key.orderBy("bin")) - F.col("cnt")).withColumn("n", F.sum("cnt").over(key))
    return bins.withColumn("r", 0.9 * (F.col("n") - 1))


def fast_histogram(obs: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA) -> DataFrame:
    """p90 by interpolation inside the bin of the rank; a single sample gives its bin's midpoint."""
    bins = _window_bins(obs, targets, delta).where((F.col("before") <= F.floor("r")) & (F.col("before") + F.col("cnt") > F.floor("r")))
    part = F.when(F.col("n") == 1, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("r") - F.col("before")) / F.col("cnt"))))
    return bins.select(F.col("target").alias("doy"), "cell", "n", F.round(LOW + (F.col("bin") + part) * WIDTH, 6).alias("p90"))


def fixed_collect(obs: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA, most: int | None = None) -> DataFrame:
    """Bins locate the rank, the values of these bins give it exactly.

    With ``most`` (256 in the original layout), windows with more values in the rank's bins fall back to the lower bin's midpoint.
    """
    bins = _window_bins(obs, targets, delta)
    low, high = F.floor("r"), F.least(F.floor("r") + 1, F.col("n") - 1)
    holds = lambda rank: (F.col("before") <= rank) & (F.col("before") + F.col("cnt") > rank)
    ranked = bins.where(holds(low) | holds(high)).groupBy("target", "cell").agg(
        F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.min("before").alias("before"), F.sum("cnt").alias("m"), F.first("n").alias("n"), F.first("r").alias("r")
    )
    # of the rank's bins, distinct values with their counts, in order: the rank's values by running counts
    daily = obs.where("v is not null").groupBy("cell", "doy", F.col("v").cast("double").alias("v")).agg(F.count("*").alias("c"))
    values = in_windows(daily, targets, delta).withColumn("bin", bin_of()).join(ranked, ["target", "cell"]).where("bin = lo or bin = hi")
    values = values.groupBy("target", "cell", "v").agg(F.sum("c").alias("c"), *(F.first(c).alias(c) for c in ("n", "m", "lo", "r", "before")))
    upto = F.col("before") + F.sum("c").over(W.partitionBy("target", "cell").orderBy("v"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    out = values.withColumn("upto", upto).groupBy("target", "cell").agg(at(low).alias("a"), at(high).alias("b"), *(F.first(c).alias(c) for c in ("n", "m", "lo", "r")))
    exact = F.col("a") + (F.col("r") - F.floor("r")) * (F.col("b") - F.col("a"))
    p90 = exact if most is None else F.when(F.col("m") > most, LOW + (F.col("lo") + 0.5) * WIDTH).otherwise(exact)
    return out.select(F.col("target").alias("doy"), "cell", "n", F.round(p90, 6).alias("p90"))
