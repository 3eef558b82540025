"""Climatology over a bounded stream of source days, in event time.

The event time is the day in a year without leap day, with no lateness; a target's window is complete
once the watermark passes its last day. Files must come in order of days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators.climatology import DELTA, SEASON, mean_of, p90_of

NO_CELL = -1


def day_time(doy):
    return F.date_add(F.lit("2001-01-01").cast("date"), doy - 1).cast("timestamp")


def write_chunks(obs: DataFrame, path: str, days: tuple[int, int], size: int, files: int = 8) -> int:
    """The source days as ``files`` files per chunk, chunks in order, and a last one that only moves the watermark on.

    Rows are dealt to the files by their cell; each file also holds one row without cell and value, so
    that none is missing and a stream of ``files`` files a trigger takes one chunk at a time.
    """
    rows = obs.select("cell", "doy", "v", F.pmod(F.xxhash64("cell"), F.lit(files)).cast("int").alias("file"))
    starts = [*range(days[0], days[1] + 1, size), days[1] + 30]
    for first in starts:
        mark = obs.sparkSession.range(files).select(F.lit(NO_CELL).alias("cell"), F.lit(first).alias("doy"), F.lit(None).cast(obs.schema["v"].dataType).alias("v"), F.col("id").cast("int").alias("file"))
        chunk = rows.where(F.col("doy").between(first, min(days[1], first + size - 1))).unionByName(mark)
        chunk.repartitionById(files, "file").drop("file").write.mode("append").parquet(path)
    return len(starts)


def stream_climatology(chunks: DataFrame, targets: tuple[int, int] = SEASON, delta: int = DELTA) -> DataFrame:
    """A streaming (or batch) DataFrame of (cell, doy, v) to doy, cell, n, clim_mean, p90; append mode."""
    rows = chunks.withColumn("ts", day_time(F.col("doy"))).withWatermark("ts", "0 seconds")
    out = rows.groupBy(F.window("ts", f"{2 * delta + 1} days", "1 day").alias("w"), "cell").agg(F.count("v").alias("n"), mean_of().alias("clim_mean"), p90_of().alias("p90"))
    out = out.withColumn("doy", (F.dayofyear("w.start") + delta).cast("int"))
    # windows of the last entries hold no value; a filter on their cell would be pushed below the watermark
    return out.where(F.col("doy").between(*targets) & (F.col("n") > 0)).select("doy", "cell", "n", "clim_mean", "p90")


def run_stream(obs: DataFrame, folder: str, targets: tuple[int, int] = SEASON, delta: int = DELTA, chunk_days: int = 16, files: int = 8) -> DataFrame:
    """Streams the obs chunk by chunk, one micro-batch each, and returns the appended result."""
    spark = obs.sparkSession
    write_chunks(obs, f"{folder}/chunks", (targets[0] - delta, targets[1] + delta), chunk_days, files)
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/chunks").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/chunks")
    query = stream_climatology(source, targets, delta).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
