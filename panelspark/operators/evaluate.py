"""Model evaluation: R2 / RMSE / MAE overall and per year, residual tables,
stage comparison.  Every metric is one grouped aggregate (partial
aggregation map-side, one shuffle on the group key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import small_side

OBS, PRED = "Observed_NEE", "Predicted_NEE"


def _metrics(y: Column, p: Column, prefix: str = "") -> list[Column]:
    err = y - p
    sse = F.sum(err * err)
    n = F.count(err)
    return [
        n.alias(f"{prefix}n"),
        (F.lit(1.0) - sse / F.nullif(F.var_pop(y) * n, F.lit(0.0))).alias(f"{prefix}r2"),
        F.sqrt(F.avg(err * err)).alias(f"{prefix}rmse"),
        F.avg(F.abs(err)).alias(f"{prefix}mae"),
    ]


def _only(cond: Column, x: Column) -> Column:
    return F.when(cond, x)


def metrics_by_split(pred: DataFrame, by=("site", "split")) -> DataFrame:
    """Long metrics per group: n, r2, rmse, mae."""
    return pred.groupBy(*by).agg(*_metrics(F.col(OBS), F.col(PRED)))


def metrics_overall(pred: DataFrame) -> DataFrame:
    """Per site: train and test metrics side by side, R2 gap and overfitting flag.

    One aggregate with split-conditional inputs (no pivot, no second shuffle).
    """
    aggs = []
    for s in ("train", "test"):
        cond = F.col("split") == s
        aggs += _metrics(_only(cond, F.col(OBS)), _only(cond, F.col(PRED)), prefix=f"{s}_")
    out = pred.groupBy("site").agg(*aggs)
    gap = F.col("train_r2") - F.col("test_r2")
    return out.withColumns({
        "r2_gap": gap,
        "overfit_check": F.when(gap > F.lit(C.OVERFIT_GAP), F.lit("check overfitting"))
                          .otherwise(F.lit("acceptable")),
    })


def metrics_by_year(pred: DataFrame, split: str = "test") -> DataFrame:
    """Per site and year of one split: n, r2, rmse, mae (all sites in one aggregate)."""
    return (pred.where(F.col("split") == split)
            .groupBy("site", "Year").agg(*_metrics(F.col(OBS), F.col(PRED))))


def metrics_table(overall: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Exported layout: Metric x (Training, Test, extra columns on the R2 row)."""
    extra = extra or {}
    structs = []
    for metric, key in (("R²", "r2"), ("RMSE", "rmse"), ("MAE", "mae")):
        fields = [F.lit(metric).alias("Metric"), F.col(f"train_{key}").alias("Training"),
                  F.col(f"test_{key}").alias("Test")]
        fields += [(v if key == "r2" else F.lit(None)).cast("double").alias(k) for k, v in extra.items()]
        structs.append(F.struct(*fields))
    return overall.select("site", F.inline(F.array(*structs)))


def residual_profile(pred: DataFrame) -> DataFrame:
    """Per site and split: n, observed range (1:1 line ends), mean residual."""
    res = F.col(OBS) - F.col(PRED)
    return pred.groupBy("site", "split").agg(
        F.count("*").alias("n"), F.min(OBS).alias("obs_min"), F.max(OBS).alias("obs_max"),
        F.avg(res).alias("mean_residual"))


def residual_histogram(pred: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width residual histogram per site and split, every bin a row (n may be 0).

    Bin i covers [min + i*w, min + (i+1)*w); the maximum falls in the last bin;
    a constant residual has width 0 and falls in bin 0.  The range is one row
    per group, broadcast once its row count is known to be small.
    """
    res = pred.select("site", "split", (F.col(OBS) - F.col(PRED)).alias("r"))
    rng = small_side(res.groupBy("site", "split").agg(F.min("r").alias("r_min"), F.max("r").alias("r_max")))
    w = (F.col("r_max") - F.col("r_min")) / F.lit(float(bins))
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("r") - F.col("r_min")) / w), F.lit(bins - 1))).cast("int")
    filled = (res.join(rng, ["site", "split"]).where(F.col("r").isNotNull())
              .groupBy("site", "split", b.alias("bin")).agg(F.count("*").alias("n")))
    every = rng.select("site", "split", "r_min", w.alias("_w"),
                       F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(filled, ["site", "split", "bin"], "left").select(
        "site", "split", "bin", F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("r_min") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("r_min") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"))


def residual_points(pred: DataFrame) -> DataFrame:
    """Scatter/time-series inputs: split, date, observed, predicted, residuals."""
    res = F.col(OBS) - F.col(PRED)
    return pred.select("site", "split", "Date", OBS, PRED, res.alias("Residual"),
                       F.abs(res).alias("Abs_Residual"))


def predictions_export(pred: DataFrame, features) -> DataFrame:
    """Test rows: Date, observed, predicted, residuals and the raw features."""
    res = F.col(OBS) - F.col(PRED)
    return (pred.where(F.col("split") == "test")
            .select("site", "Date", OBS, PRED, res.alias("Residual"), F.abs(res).alias("Abs_Residual"),
                    *features))


def metrics_compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Test metrics of two prediction tables per site, with the improvement.

    The tables are tagged, unioned and aggregated once; R2 improvement is
    second - first, RMSE/MAE improvement first - second.
    """
    cols = ["site", "split", OBS, PRED]
    both = (first.select(*cols, F.lit(1).alias("_stage"))
            .unionByName(second.select(*cols, F.lit(2).alias("_stage")))
            .where(F.col("split") == "test"))
    aggs = []
    for s in (1, 2):
        cond = F.col("_stage") == s
        aggs += _metrics(_only(cond, F.col(OBS)), _only(cond, F.col(PRED)), prefix=f"s{s}_")
    wide = both.groupBy("site").agg(*aggs)
    structs = [F.struct(F.lit(metric).alias("Metric"), F.col(f"s1_{key}").alias("Stage1"),
                        F.col(f"s2_{key}").alias("Stage2"),
                        (F.lit(sign) * (F.col(f"s2_{key}") - F.col(f"s1_{key}"))).alias("Improvement"))
               for metric, key, sign in (("R2", "r2", 1.0), ("RMSE", "rmse", -1.0), ("MAE", "mae", -1.0))]
    return wide.select("site", F.inline(F.array(*structs)))
