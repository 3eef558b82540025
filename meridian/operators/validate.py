"""Field statistics and errors of a candidate against a reference climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.calendar import mmdd, noleap_doy
from meridian.sources.grid_nc import read_fields


def field_statistics(result: DataFrame, column: str) -> DataFrame:
    """Per day: present, missing and zero values, least and largest."""
    c = F.col(column)
    return result.groupBy("doy").agg(F.count(c).alias("finite"), F.count_if(c.isNull()).alias("missing"), F.count_if(c == 0).alias("zeros"), F.min(c).alias("least"), F.max(c).alias("largest"))


def daily_rmse(reference: DataFrame, candidate: DataFrame, days: list[str] | None = None) -> DataFrame:
    """doy, rmse_clim, rmse_p90 over the cells both have; ``days`` may list MMDD or MMDD.nc names."""
    r = reference.select("doy", "cell", F.col("clim_mean").alias("r_mean"), F.col("p90").alias("r_p90"))
    both = candidate.join(r, ["doy", "cell"])
    if days is not None:
        both = both.where(mmdd(F.col("doy")).isin([d.strip().removesuffix(".nc") for d in days]))
    rmse = lambda a, b: F.round(F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))), 6)
    return both.groupBy("doy").agg(rmse("clim_mean", "r_mean").alias("rmse_clim"), rmse("p90", "r_p90").alias("rmse_p90"))


def unmatched_cells(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """doy, only_reference, only_candidate: numbers of cells that one side lacks, for the days on which there are any."""
    side = lambda df, name: df.select("doy", "cell", F.lit(True).alias(name))
    both = side(reference, "r").join(side(candidate, "c"), ["doy", "cell"], "full")
    counts = both.groupBy("doy").agg(F.count_if(F.col("c").isNull()).alias("only_reference"), F.count_if(F.col("r").isNull()).alias("only_candidate"))
    return counts.where("only_reference + only_candidate > 0")


def rmse_of_files(spark: SparkSession, reference: str, candidate: str, days: list[str] | None = None, on_error: str = "fail") -> DataFrame:
    """``daily_rmse`` of two folders of MMDD.nc files (variables Climmean and P90_sst over Lat and Lon)."""

    def side(folder: str) -> DataFrame:
        fields = read_fields(spark, f"{folder.rstrip('/')}/*.nc", ["Climmean", "P90_sst"], "Lat", "Lon", on_error)
        day = noleap_doy(F.to_date(F.concat(F.lit("2001"), F.substring("file", 1, 4)), "yyyyMMdd")).cast("int")
        return fields.select(day.alias("doy"), F.struct("lat_idx", "lon_idx").alias("cell"), F.col("Climmean").alias("clim_mean"), F.col("P90_sst").alias("p90"))

    return daily_rmse(side(reference), side(candidate), days)


def season_rmse(daily: DataFrame) -> DataFrame:
    return daily.agg(*(f(c).alias(f"{name}_{c}") for c in ("rmse_clim", "rmse_p90") for name, f in (("mean", lambda x: F.round(F.avg(x), 4)), ("max", F.max))))


def threshold_report(daily: DataFrame, day_limit: float, season_limit: float) -> DataFrame:
    """Days at or over the daily limit, and whether daily and season limits hold."""
    return daily.agg(
        F.count_if(F.col("rmse_clim") >= day_limit).alias("clim_days_over"), F.count_if(F.col("rmse_p90") >= day_limit).alias("p90_days_over"),
        ((F.max("rmse_clim") < day_limit) & (F.max("rmse_p90") < day_limit)).alias("days_ok"), ((F.avg("rmse_clim") < season_limit) & (F.avg("rmse_p90") < season_limit)).alias("season_ok"),
    )


def write_report(daily: DataFrame, folder: str) -> None:
    """The errors as text: RMSE_*_daily, a line per day in order (92 lines a season), and RMSE_*, the season's mean."""
    for column, name in (("rmse_clim", "RMSE_clim"), ("rmse_p90", "RMSE_P90")):
        daily.orderBy("doy").select(F.format_string("%.6f", column)).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}_daily")
        daily.agg(F.avg(column).alias("mean")).select(F.format_string("%.4f", "mean")).write.mode("overwrite").text(f"{folder}/{name}")


def spot_check(exact: DataFrame, estimate: DataFrame, stride: int = 97, most: int = 8) -> DataFrame:
    """The first cells of every ``stride`` that have samples: exact and estimated percentile."""
    cells = exact.where((F.col("cell") % stride == 0) & (F.col("n") > 0)).select("cell").distinct().orderBy("cell").limit(most)
    picked = exact.join(cells, "cell", "left_semi").select("doy", "cell", F.col("p90").alias("exact"))
    return picked.join(estimate.select("doy", "cell", F.col("p90").alias("estimate")), ["doy", "cell"], "left").withColumn("difference", F.round(F.abs(F.col("exact") - F.col("estimate")), 6))
