"""Sources and sinks: CSV round trip, NaN cells, optional tables."""

import datetime as dt

from pyspark.sql import types as T

from panelspark.session import scratch_path
from panelspark.sources import files as FS


def test_csv_round_trip_any_column_order(spark):
    base = scratch_path(spark, "t-csv")
    path = FS.site_path(base, "F")
    spark.createDataFrame([("NaN", "2001-01-02", "1.5"), (None, "2001-01-03", "2.5")],
                          "RH string, Date string, TA string") \
        .select("TA", "Date", "RH").write.option("header", True).csv(path)
    df = FS.scan_panel(spark, path, site="F", columns=["TA", "RH"])
    rows = sorted(df.collect(), key=lambda r: r["Date"])
    assert df.columns == ["site", "Date", "TA", "RH"]
    assert rows[0]["Date"] == dt.date(2001, 1, 2) and rows[0]["TA"] == 1.5 and rows[0]["RH"] is None
    assert rows[1]["RH"] is None


def test_read_optional_missing_path(spark):
    schema = T.StructType([T.StructField("Metric", T.StringType()), T.StructField("Test", T.DoubleType())])
    df = FS.read_optional(spark, scratch_path(spark, "missing"), schema)
    assert df.count() == 0 and df.schema == schema


def test_sink_round_trip(spark):
    df = spark.createDataFrame([("F", 1.25, "a"), ("O", -0.5, None)], "site string, v double, s string")
    path = FS.sink_table(df, scratch_path(spark, "t-sink"), "parquet", partition_by=["site"])
    back = spark.read.parquet(path).select("site", "v", "s")
    assert sorted(back.collect()) == sorted(df.collect())
