"""Observations stored for the plans that read them again and again.

By day: one folder a year and day, named by one number, so a join with a plan of sampled days reads their
folders alone (two columns would be pruned by themselves, which leaves all their combinations). By
tile: files bucketed by tile, so work grouped by tile needs no exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def day_number(year: Column, doy: Column) -> Column:
    return (year * 1000 + doy).cast("int")


def write_by_day(obs: DataFrame, path: str) -> DataFrame:
    """Stores (cell, year, doy, v) by day, a file each, and gives the stored table, which has ``day`` too."""
    days = obs.select("cell", "year", "doy", "v", day_number(F.col("year"), F.col("doy")).alias("day"))
    days.repartition("day").write.partitionBy("day").parquet(path)
    return read_by_day(obs.sparkSession, path)


def read_by_day(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by_tile(obs: DataFrame, path: str, tile_cells: int, buckets: int) -> DataFrame:
    """Stores (cell, year, doy, v) with their tile, bucketed and sorted by it, as a table of the session's catalog, and gives that table."""
    spark, name = obs.sparkSession, f"tiled_{uuid.uuid4().hex}"
    tiled = obs.select(F.expr(f"cell div {tile_cells}").cast("int").alias("tile"), "cell", "year", "doy", "v")
    # dealt as the buckets are, so a task writes one bucket's file
    tiled.repartition(buckets, "tile").write.bucketBy(buckets, "tile").sortBy("tile").option("path", path).saveAsTable(name)
    return spark.table(name)
