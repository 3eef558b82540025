"""The 365-day calendar: day-of-year 1..365 in every year, February 29 left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_leap(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def is_feb29(date: Column) -> Column:
    return (F.month(date) == 2) & (F.dayofmonth(date) == 29)


def noleap_doy(date: Column) -> Column:
    """1..365; null for February 29."""
    shift = F.when((F.month(date) > 2) & is_leap(F.year(date)), 1).otherwise(0)
    return F.when(~is_feb29(date), F.dayofyear(date) - shift)


def noleap_date(year: Column, doy: Column) -> Column:
    """The date of a day-of-year; null outside 1..365."""
    shift = F.when((doy >= 60) & is_leap(year), 1).otherwise(0)
    return F.when(doy.between(1, 365), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1 + shift).cast("int")))


def mmdd(doy: Column) -> Column:
    """Month and day of a day-of-year, as in the names of output files."""
    return F.date_format(noleap_date(F.lit(2001), doy), "MMdd")


def yyyymmdd(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def sample_dates(years: Column, doy: Column, delta: int) -> Column:
    """Array of (year, offset, date): the dates within ``delta`` real calendar days of the day in each year."""
    offsets = F.sequence(F.lit(-delta), F.lit(delta))
    per_year = F.transform(years, lambda y: F.transform(offsets, lambda o: F.struct(y.alias("year"), o.alias("offset"), F.date_add(noleap_date(y, doy), o).alias("date"))))
    return F.flatten(per_year)
