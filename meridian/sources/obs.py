"""Observations: one row per cell, year and day-of-year, with a value that is null where missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.calendar import noleap_doy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(rows: DataFrame, years: tuple[int, int]) -> DataFrame:
    """(cell, date, v) to obs: one sample per cell, year and day, the day's largest value; February 29 is dropped."""
    keyed = rows.select("cell", F.year("date").alias("year"), noleap_doy(F.col("date")).cast("int").alias("doy"), "v")
    return keyed.where(F.col("year").between(*years) & F.col("doy").isNotNull()).groupBy("cell", "year", "doy").agg(F.max("v").alias("v"))


def from_lineitem(spark: SparkSession, sf_dir: str, years: tuple[int, int] = (1995, 2000)) -> DataFrame:
    """Extended prices by the supplier's nation."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("cell"))
    return daily(items.join(suppliers, items.l_suppkey == suppliers.s_suppkey), years)


def from_orders(spark: SparkSession, sf_dir: str, years: tuple[int, int] = (1995, 2000)) -> DataFrame:
    """Order totals by the customer's nation."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("cell"))
    return daily(orders.join(customers, orders.o_custkey == customers.c_custkey), years)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values / 5 by user group; every event is a sample."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 25).cast("int").alias("cell"), F.year("ts").alias("year"), noleap_doy(F.to_date("ts")).cast("int").alias("doy"), (F.col("value") / 5).alias("v"))


def cleaned(obs: DataFrame, fill=None, missing=None, scale=None, offset=None, value: str = "v") -> DataFrame:
    """NaN, the fill value and the missing value (compared before scaling) become null; then value * scale + offset."""
    raw = F.col(value)
    marks = [F.lit(x) for x in (fill, missing) if x is not None]
    gone = raw.isin(*marks) if marks else F.lit(False)
    if obs.schema[value].dataType.typeName() in ("float", "double"):
        gone = gone | F.isnan(raw)
    v = F.when(~gone, raw)
    if scale is not None or offset is not None:
        v = v * (1 if scale is None else scale) + (0 if offset is None else offset)
    return obs.withColumn(value, v)


def spine(obs: DataFrame, targets: tuple[int, int]) -> DataFrame:
    """Every (cell, doy) of the cells seen and the target days."""
    return obs.select("cell").distinct().select("cell", F.explode(F.sequence(F.lit(targets[0]), F.lit(targets[1]))).alias("doy"))


def missing_days(obs: DataFrame, years: tuple[int, int], days: tuple[int, int]) -> DataFrame:
    """(year, doy) pairs without any observation: files that a daily archive lacks."""
    all_days = obs.sparkSession.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(days[0]), F.lit(days[1]))).alias("doy"))
    return all_days.join(obs.select("year", "doy").distinct(), ["year", "doy"], "left_anti")


def missing_cell_days(obs: DataFrame, years: tuple[int, int], days: tuple[int, int]) -> DataFrame:
    """(cell, year, doy) of the cells seen without an observation."""
    all_days = spine(obs, days).withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    return all_days.join(obs.select("cell", "year", "doy").distinct(), ["cell", "year", "doy"], "left_anti").select("cell", "year", "doy")


def with_grid(obs: DataFrame, n_lon: int) -> DataFrame:
    return obs.withColumn("lat_idx", F.expr(f"cell div {n_lon}").cast("int")).withColumn("lon_idx", (F.col("cell") % n_lon).cast("int"))


def with_tiles(obs: DataFrame, n_lat: int, bands: int) -> DataFrame:
    """Latitude bands of ceil(n_lat / bands) rows."""
    return obs.withColumn("tile", F.expr(f"lat_idx div {-(-n_lat // bands)}").cast("int"))


def packed_planes(obs: DataFrame, n_lat: int, n_lon: int, lon_major: bool) -> DataFrame:
    """(year, doy, plane): a day's field as an array of n_lat * n_lon values, null where missing.

    The day's values are sorted by their place, and the gaps between them filled: n log n for n cells.
    """
    at = F.col("lon_idx") * n_lat + F.col("lat_idx") if lon_major else F.col("lat_idx") * n_lon + F.col("lon_idx")
    kind = obs.schema["v"].dataType.simpleString()
    end = F.array(F.struct(F.lit(n_lat * n_lon).alias("at"), F.lit(None).cast(kind).alias("v")))
    held = obs.groupBy("year", "doy").agg(F.array_sort(F.collect_list(F.struct(at.cast("int").alias("at"), "v"))).alias("held"))
    held = held.select("year", "doy", F.concat("held", end).alias("held"))
    # before each value, a null for each place since the one before
    gap = f"array_repeat(cast(null as {kind}), x.at - if(i = 0, 0, held[i - 1].at + 1))"
    return held.select("year", "doy", F.expr(f"slice(flatten(transform(held, (x, i) -> concat({gap}, array(x.v)))), 1, {n_lat * n_lon})").alias("plane"))


def unpacked_planes(planes: DataFrame, n_lat: int, n_lon: int, lon_major: bool) -> DataFrame:
    """Rows of a packed field, in either order of its two dimensions."""
    rows = planes.select("year", "doy", F.posexplode("plane").alias("at", "v"))
    inner, lat, lon = (n_lat, "at % {0}", "at div {0}") if lon_major else (n_lon, "at div {0}", "at % {0}")
    return rows.select("year", "doy", F.expr(lat.format(inner)).cast("int").alias("lat_idx"), F.expr(lon.format(inner)).cast("int").alias("lon_idx"), "v")
