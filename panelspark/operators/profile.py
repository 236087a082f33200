"""Panel profile: rows, date range and years per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def panel_profile(df: DataFrame) -> DataFrame:
    """Per site and year: rows and date range; rolled up to the site on the small result."""
    per_year = df.groupBy("site", "Year").agg(
        F.count("*").alias("n_rows"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))
    w = Window.partitionBy("site")
    return per_year.select(
        "site", "Year", "n_rows", "first_date", "last_date",
        F.sum("n_rows").over(w).alias("site_rows"),
        F.min("first_date").over(w).alias("site_first_date"),
        F.max("last_date").over(w).alias("site_last_date"),
        F.count("*").over(w).alias("site_years"))
