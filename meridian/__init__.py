"""meridian: day-of-year climatology on Spark DataFrames."""
