"""Daily site panel derived from the order/line-item tables.

The analysis expects one row per (site, Date) with a signed target and a set
of daily measurements plus trailing-window lags.  The given tables carry no
such columns, so the panel is aggregated from ``orders`` joined to
``lineitem``: the site is the order status, the day is the order date.

Scale notes
-----------
* Scans are pruned to the columns used; a site filter, if one is asked for,
  is pushed into the ``orders`` scan.
* Line items join orders on the order key (AQE broadcasts only a side it has
  measured). All algebraic aggregates are first taken per day and discount
  (a column with few values) and then per day, so the exact median is a
  frequency-weighted percentile over a few rows and a hot site or day never
  puts raw rows in one task. Distinct suppliers are counted in a branch of
  their own that carries nothing but its key.
* The lag windows run on the aggregated panel (sites x days), partitioned
  by site and ordered once by day number; all 16 lags share that sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAG_DAYS = (1, 3, 7, 14)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _total(x: Column) -> Column:
    return F.sum(x.cast("decimal(18,6)"))


def daily_panel(spark: SparkSession, sf_dir: str, sites=None) -> DataFrame:
    """Raw daily panel without lags (one row per site and day); ``sites=None`` keeps every site."""
    orders = read_table(spark, sf_dir, "orders")
    if sites is not None:
        orders = orders.where(F.col("o_orderstatus").isin(*sites))
    orders = orders.select("o_orderkey", F.col("o_orderstatus").alias("site"),
                           F.col("o_orderdate").cast("date").alias("Date"), "o_totalprice")
    items = read_table(spark, sf_dir, "lineitem")

    def joined(*cols):
        return items.select("l_orderkey", *cols).join(orders, items.l_orderkey == orders.o_orderkey)

    q, d, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    returned = F.when(F.col("l_returnflag") == "R", F.lit(1.0)).otherwise(F.lit(0.0))
    sums = {"yield": q * (F.lit(1.0) - d), "price": p, "returned": returned, "tax": F.col("l_tax"),
            "discount": d, "quantity": q}
    per_discount = joined("l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_returnflag").groupBy(
        "site", "Date", "l_discount").agg(
        *[_total(x).alias(f"s_{k}") for k, x in sums.items()], *[F.count(x).alias(f"n_{k}") for k, x in sums.items()],
        F.sum((p * p).cast("decimal(28,6)")).alias("s_price2"), F.min(p).alias("lo"), F.max(p).alias("hi"),
        F.max("o_totalprice").alias("order_price"))

    def mean(k):
        return F.sum(f"s_{k}").cast("double") / F.sum(f"n_{k}")

    n = F.sum("n_price")
    spread = (F.sum("s_price2") - F.sum("s_price") * F.sum("s_price") / n.cast("decimal(18,0)")).cast("double")
    daily = per_discount.groupBy("site", "Date").agg(
        (mean("yield") - mean("price") / F.lit(5e3) - F.lit(14.0)).alias("NEE_U50_f"),
        (F.lit(1e2) * mean("returned")).alias("Snow_Cover_Percentage"),
        F.percentile(d, F.lit(0.5), F.greatest("n_discount", F.lit(1))).alias("NDVI_nonSR_Median"),
        F.max(d).alias("NDVI_nonSR_Max"),
        (F.lit(1e2) * mean("tax")).alias("RH"),
        (F.lit(1e2) * mean("discount")).alias("TA"),
        (F.lit(1e2) * F.min(d)).alias("TA_min"),
        (F.lit(1e2) * F.max(d)).alias("TA_max"),
        (mean("price") / F.lit(1e3)).alias("RG"),
        (F.min("lo") / F.lit(1e3)).alias("RG_min"),
        (F.max("hi") / F.lit(1e3)).alias("RG_max"),
        F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))) / F.lit(1e3)).alias("VPD_f"),
        F.sum("s_quantity").cast("double").alias("precipitation_rate"),
        mean("quantity").alias("SWC_10cm"),
        (F.max("order_price") / F.lit(1e3)).alias("TS_10cm"))
    suppliers = (joined("l_suppkey").select("site", "Date", "l_suppkey").distinct()
                 .groupBy("site", "Date").agg(F.count("l_suppkey").cast("double").alias("D_SNOW")))
    return daily.join(suppliers, ["site", "Date"]).select(
        "site", "Date", "NEE_U50_f", "Snow_Cover_Percentage", "D_SNOW", "NDVI_nonSR_Median", "NDVI_nonSR_Max", "RH", "TA",
        "TA_min", "TA_max", "RG", "RG_min", "RG_max", "VPD_f", "precipitation_rate", "SWC_10cm", "TS_10cm")


BLOCK_DAYS = 512                     # days of a site's history that one task sees, besides the halo


def _lag_mean(x: str, w: Window) -> Column:
    c = F.col(x)
    return (F.sum(c.cast("decimal(28,12)")).over(w).cast("double")
            / F.nullif(F.count(c).over(w), F.lit(0)))


def _lag_sum(x: str, w: Window) -> Column:
    return F.sum(F.col(x).cast("decimal(28,12)")).over(w).cast("double")


def _time_blocks(daily: DataFrame) -> DataFrame:
    """Rows with their time block; the last days of a block are repeated, as its halo, in the next one."""
    halo = F.pmod("_day", F.lit(BLOCK_DAYS)) >= BLOCK_DAYS - max(LAG_DAYS)
    block = F.floor(F.col("_day") / BLOCK_DAYS).cast("int")
    places = F.when(halo, F.array(F.struct(block.alias("_block"), F.lit(False).alias("_halo")),
                                  F.struct((block + 1).alias("_block"), F.lit(True).alias("_halo")))
                    ).otherwise(F.array(F.struct(block.alias("_block"), F.lit(False).alias("_halo"))))
    return daily.select("*", F.inline(places))


def _last_before(blocks: DataFrame) -> DataFrame:
    """(site, _block, _last): the last day with a row before each block (one row per site and block)."""
    days = blocks.where("not _halo").groupBy("site", "_block").agg(F.max("Date").alias("_last"))
    earlier = days.select("site", F.col("_block").alias("_earlier"), "_last")
    return (days.select("site", "_block").join(earlier, "site").where("_earlier < _block")
            .groupBy("site", "_block").agg(F.max("_last").alias("_last")))


def driver_panel(spark: SparkSession, sf_dir: str, sites=None) -> DataFrame:
    """Full panel: daily measurements, days since previous record, 16 lags.

    Lags are averages (sums for precipitation) over the previous N calendar
    days, today excluded; NULL when the frame holds no row. A site's history is
    cut into blocks of ``BLOCK_DAYS`` days with a halo of the longest lag, so no
    task needs a whole site.
    """
    return trailing(daily_panel(spark, sf_dir, sites))


def trailing(daily: DataFrame) -> DataFrame:
    """``driver_panel`` of any daily table with the measurements that are averaged."""
    blocks = _time_blocks(daily.withColumn("_day", F.unix_date("Date")))
    by_block = Window.partitionBy("site", "_block").orderBy("_day")
    cols = [F.lag("Date").over(by_block).alias("_before")]
    for n in LAG_DAYS:
        w = by_block.rangeBetween(-n, -1)
        cols += [_lag_mean("TA", w).alias(f"TA_lag{n}d"),
                 _lag_mean("TS_10cm", w).alias(f"TS_lag{n}d"),
                 _lag_mean("SWC_10cm", w).alias(f"SWC_lag{n}d"),
                 _lag_sum("precipitation_rate", w).alias(f"P_lag{n}d")]
    since = F.datediff("Date", F.coalesce("_before", "_last")).cast("double").alias("DSSM")
    lags = [f"{x}_lag{n}d" for n in LAG_DAYS for x in ("TA", "TS", "SWC", "P")]
    return (blocks.select("*", *cols).where("not _halo").join(_last_before(blocks), ["site", "_block"], "left")
            .select(*daily.columns, since, *lags))
