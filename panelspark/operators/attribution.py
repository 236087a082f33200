"""Attribution tables built from per-row SHAP columns (``SHAP_<feature>``).

Wide SHAP rows are turned long with ``inline`` over an array of structs (a
narrow, per-row operation: no join, no shuffle), so value and attribution
of a feature stay on the same row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import feature_family
from ..session import small_side
from .ordering import as_is


def shap_values_long(df: DataFrame, features, keys=("site", "Date"), extra=(), with_value: bool = True) -> DataFrame:
    """(keys..., extra..., Feature, [value,] shap) for every row and feature."""
    entries = [F.struct(F.lit(f).alias("Feature"),
                        *([F.col(f).cast("double").alias("value")] if with_value else []),
                        F.col(f"SHAP_{f}").alias("shap")) for f in features]
    return df.select(*keys, *extra, F.inline(F.array(*entries)))


def shap_summary(long: DataFrame, by=("site",), order_key=as_is) -> DataFrame:
    """Mean |SHAP|, mean SHAP and population std per feature, ranked by mean |SHAP|."""
    agg = long.groupBy(*by, "Feature").agg(
        F.avg(F.abs("shap")).alias("Mean_Abs_SHAP"), F.avg("shap").alias("Mean_SHAP"),
        F.stddev_pop("shap").alias("Std_SHAP"))
    w = Window.partitionBy(*by).orderBy(order_key(F.col("Mean_Abs_SHAP")).desc_nulls_last(), F.col("Feature"))
    return agg.withColumn("rank", F.row_number().over(w))


def top_n_shap(long: DataFrame, n: int | None, by=("site",), exclude=tuple(C.SEASONAL),
               order_key=as_is) -> DataFrame:
    """Per group the n features with the largest mean |SHAP|, seasonal angle excluded.

    ``n=None`` keeps every feature, the seasonal ones included.
    """
    src = long if n is None else long.where(~F.col("Feature").isin(*exclude))
    return rank_features(src.groupBy(*by, "Feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")), n, by, order_key)


def rank_features(agg: DataFrame, n: int | None, by=("site",), order_key=as_is) -> DataFrame:
    """The first n of each group's (Feature, mean_abs_shap) rows, all for ``n=None``."""
    w = Window.partitionBy(*by).orderBy(order_key(F.col("mean_abs_shap")).desc_nulls_last(), F.col("Feature"))
    ranked = agg.withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def with_family(df: DataFrame, feature: str = "Feature") -> DataFrame:
    return df.withColumn("family", feature_family(feature))


def shap_dependence(long: DataFrame, top: DataFrame, by=("site",)) -> DataFrame:
    """(feature value, SHAP) points of each group's top features (semi join on a tiny table)."""
    return long.join(top.select(*by, "Feature", "rank"), [*by, "Feature"], "inner")


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
ACCURACY = 10_000                    # rank error of the quantiles: at most rows / ACCURACY
DENSITY_BINS = 50


def shap_quantiles(long: DataFrame, by=("site",), probs=QUANTILES, accuracy: int = ACCURACY) -> DataFrame:
    """Summary-plot quantiles of SHAP per feature: (by..., Feature, n, shap_min, q05 ... q95, shap_max).

    The quantile at p is the value of rank ceil(p * n), from a mergeable sketch whose ranks
    are off by at most n / ``accuracy`` (exact up to ``accuracy`` rows); partial sketches are
    built where the rows are.
    """
    q = F.percentile_approx("shap", list(probs), accuracy)
    agg = long.groupBy(*by, "Feature").agg(F.count("shap").alias("n"), F.min("shap").alias("shap_min"), q.alias("_q"),
                                           F.max("shap").alias("shap_max"))
    return agg.select(*by, "Feature", "n", "shap_min",
                      *[F.col("_q")[i].alias(f"q{round(p * 100):02d}") for i, p in enumerate(probs)], "shap_max")


def shap_density(long: DataFrame, by=("site",), bins: int = DENSITY_BINS) -> DataFrame:
    """Violin data: equal-width bins of SHAP per feature with counts, density and the mean feature value (its colour).

    Every bin is a row; the density of a feature sums to 1 over bin widths (null for a constant feature's width 0).
    """
    keys = [*by, "Feature"]
    ranges = small_side(long.groupBy(*keys).agg(F.min("shap").alias("_low"), F.max("shap").alias("_high"), F.count("shap").alias("_all")))
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    bin_ = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("shap") - F.col("_low")) / width), F.lit(bins - 1))).cast("int")
    filled = (long.where(F.col("shap").isNotNull()).join(ranges, keys).groupBy(*keys, bin_.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.avg("value").cast("double").alias("mean_value")))
    every = ranges.select(*keys, "_low", "_all", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return every.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", n.alias("n"), (F.col("_low") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("_low") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"),
        (n / F.nullif(F.col("_all") * F.col("_w"), F.lit(0.0))).alias("density"), "mean_value")


def shap_explain_rows(long: DataFrame, picks: DataFrame, keys=("site", "Date"), order_key=as_is) -> DataFrame:
    """Waterfall data for the picked rows: contributions by |SHAP|, running total from the base."""
    rows = picks.select(*keys, "quantile_slot", "base_value", "Predicted_NEE")
    j = long.join(rows, list(keys), "inner")
    w = Window.partitionBy("site", "quantile_slot").orderBy(order_key(F.abs("shap")).desc(), F.col("Feature"))
    return j.withColumns({
        "order": F.row_number().over(w),
        "running_total": F.col("base_value") + F.sum("shap").over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })


def shap_export_test(df: DataFrame, features) -> DataFrame:
    """Test rows: Date, Year, Month and the SHAP columns."""
    return (df.where(F.col("split") == "test")
            .select("site", "Date", F.year("Date").alias("Year"), F.month("Date").alias("Month"),
                    *[f"SHAP_{f}" for f in features]))


def shap_export_full(df: DataFrame, features, residuals: bool = True) -> DataFrame:
    """All rows: dates, observed, predicted (residuals), SHAP columns."""
    cols = ["site", "Date", F.year("Date").alias("Year"), F.month("Date").alias("Month"),
            "Observed_NEE", "Predicted_NEE"]
    if residuals:
        res = F.col("Observed_NEE") - F.col("Predicted_NEE")
        cols += [res.alias("Residual"), F.abs(res).alias("Abs_Residual")]
    return df.select(*cols, *[f"SHAP_{f}" for f in features])
