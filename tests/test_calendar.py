import datetime as dt

from pyspark.sql import functions as F

from meridian.functions import calendar as cal


def test_vectors_and_round_trip(spark):
    rows = spark.range(1991, 2021).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(365))).alias("doy"))
    rows = rows.withColumn("d", cal.noleap_date(F.col("y"), F.col("doy"))).withColumn("again", cal.noleap_doy(F.col("d")))
    assert rows.where("again <> doy or d is null").count() == 0
    known = {59: "0228", 60: "0301", 152: "0601", 243: "0831", 365: "1231"}
    for y in (2000, 2001):
        got = {r.doy: r.d for r in rows.where(F.col("y") == y).where(F.col("doy").isin(list(known))).collect()}
        assert {k: v.strftime("%m%d") for k, v in got.items()} == known


def test_leap_february_and_bounds(spark):
    d = spark.createDataFrame([(dt.date(2000, 2, 29), 2000), (dt.date(1900, 2, 28), 1900)], "d date, y int")
    got = d.select(cal.is_leap(F.col("y")).alias("leap"), cal.days_in_month(F.col("y"), F.lit(2)).alias("n"), cal.noleap_doy(F.col("d")).alias("doy")).collect()
    assert [tuple(r) for r in got] == [(True, 29, None), (False, 28, 59)]
    out = spark.range(1).select(*(cal.noleap_date(F.lit(2001), F.lit(x)).alias(str(x)) for x in (0, 366))).first()
    assert tuple(out) == (None, None)


def test_sample_dates_use_real_days(spark):
    got = spark.range(1).select(F.explode(cal.sample_dates(F.array(F.lit(2000)), F.lit(61), 2)).alias("s")).select("s.*").orderBy("offset").collect()
    assert [r.date.strftime("%m%d") for r in got] == ["0229", "0301", "0302", "0303", "0304"]
