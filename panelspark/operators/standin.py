"""A linear stand-in predictor with exact attributions.

The downstream operators (metrics, residuals, SHAP summaries, weekly
calendars, exports) need only *some* prediction and per-feature attribution
columns.  For checks against an independent SQL statement they run on this
predictor, whose arithmetic both engines evaluate identically:

    Predicted = mean_train(y) + sum_f c_f * (x_f - mean_train(x_f))
    SHAP_f    = c_f * (x_f - mean_train(x_f))

The attributions are the exact Shapley values of the linear model, so the
additivity invariant (sum of SHAP + base = prediction) holds as for forests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side


def coefficients(features) -> dict[str, float]:
    """c_i = (i mod 4 - 1.5) / 2, i.e. -0.75, -0.25, 0.25, 0.75 repeating."""
    return {f: ((i % 4) - 1.5) / 2 for i, f in enumerate(features)}


def _mean(x: str):
    # exact decimal sum: the same double in every engine
    return F.sum(F.col(x).cast("decimal(28,12)")).cast("double") / F.count(x)


def _mean_sql(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,12))) AS DOUBLE) / count({x})"


def standin_predict(df: DataFrame, features, target: str, split_col: str = "split") -> DataFrame:
    """Add base_value, Predicted_NEE, Observed_NEE and SHAP_<f> columns (per site fit on train)."""
    coef = coefficients(features)
    stats = (df.where(F.col(split_col) == "train").groupBy("site")
             .agg(_mean(target).alias("base_value"), *[_mean(f).alias(f"_m_{f}") for f in features]))
    out = df.join(small_side(stats), "site", "left")
    shap = {f"SHAP_{f}": F.lit(coef[f]) * (F.col(f) - F.col(f"_m_{f}")) for f in features}
    out = out.withColumns(shap)
    pred = F.col("base_value")
    for f in features:
        pred = pred + F.col(f"SHAP_{f}")
    return (out.withColumns({"Observed_NEE": F.col(target), "Predicted_NEE": pred})
            .drop(*[f"_m_{f}" for f in features]))


def standin_sql(features, target: str, source: str, name: str = "standin") -> str:
    coef = coefficients(features)
    means = ", ".join(f"{_mean_sql(f)} AS _m_{f}" for f in features)
    shap = ",\n    ".join(f"{coef[f]!r} * ({f} - _m_{f}) AS SHAP_{f}" for f in features)
    pred = " + ".join(["base_value"] + [f"{coef[f]!r} * ({f} - _m_{f})" for f in features])
    return f"""
{name}_stats AS (
  SELECT site, {_mean_sql(target)} AS base_value, {means}
  FROM {source} WHERE split = 'train' GROUP BY site
),
{name} AS (
  SELECT s.*, st.base_value, s.{target} AS Observed_NEE, {pred} AS Predicted_NEE,
    {shap}
  FROM {source} s JOIN {name}_stats st USING (site)
)"""


class MarginalEstimator:
    """A closed-form estimator for the feature elimination.

    Predicts the mean plus the average of the one-variable regressions; a
    feature's importance is the absolute value of its correlation.
    """

    def fit(self, train: DataFrame, features, label: str) -> dict:
        row = train.agg(F.avg(label).alias("mean"), *[
            F.struct(F.avg(f).alias("mean"), (F.covar_pop(f, label) / F.nullif(F.var_pop(f), F.lit(0.0))).alias("slope"),
                     F.abs(F.covar_pop(f, label) / F.nullif(F.stddev_pop(f) * F.stddev_pop(label), F.lit(0.0))).alias("r"))
            .alias(f) for f in features]).first()
        return {"mean": row["mean"], "features": {f: row[f].asDict() for f in features}}

    def predict(self, model: dict, df: DataFrame, features) -> DataFrame:
        total = F.lit(0.0)
        for f in features:
            m = model["features"][f]
            total = total + F.lit(m["slope"] or 0.0) * (F.col(f) - F.lit(m["mean"]))
        return df.withColumn("Predicted_NEE", F.lit(model["mean"]) + total / F.lit(float(len(features))))

    def importances(self, model: dict) -> list[float]:
        return [m["r"] or 0.0 for m in model["features"].values()]
