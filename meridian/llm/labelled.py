"""Folds and bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the text '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def smallest_hashes(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, the ones with the smallest hash of their id: the same at every run and layout."""
    return df.orderBy(F.xxhash64(id_col, F.lit(17)), id_col).limit(most)

