"""Scalar column functions (all built-in expressions, inside whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cyclic_doy(date="Date") -> tuple[Column, Column]:
    """Seasonal angle of the day of year; the year length is always 365."""
    angle = F.lit(2 * math.pi) * F.dayofyear(_c(date)) / F.lit(365)
    return F.sin(angle).alias("sin_doy"), F.cos(angle).alias("cos_doy")


def with_cyclic_doy(df: DataFrame, date="Date") -> DataFrame:
    s, c = cyclic_doy(date)
    return df.withColumns({"sin_doy": s, "cos_doy": c})


def date_parts(date="Date") -> list[Column]:
    d = _c(date)
    return [F.year(d).alias("Year"), F.month(d).alias("Month"), F.dayofyear(d).alias("DOY")]


def with_date_parts(df: DataFrame, date="Date") -> DataFrame:
    y, m, doy = date_parts(date)
    return df.withColumns({"Year": y, "Month": m, "DOY": doy})


def residual(observed="Observed_NEE", predicted="Predicted_NEE") -> tuple[Column, Column]:
    r = _c(observed) - _c(predicted)
    return r.alias("Residual"), F.abs(r).alias("Abs_Residual")


# Feature-family rules, evaluated in this order (first match wins).
#   starts with TA -> air_temperature; TS -> soil_temperature; SWC -> soil_water;
#   RG -> radiation; starts with P_lag or equals precipitation_rate -> precipitation;
#   contains Snow or equals DSSM / D_SNOW -> snow; equals VPD_f / RH -> humidity;
#   contains NDVI -> vegetation; contains sin_doy -> season_sin;
#   contains cos_doy -> season_cos; anything else -> other.
def feature_family(feature="Feature") -> Column:
    f = F.regexp_replace(_c(feature), "^SHAP_", "")
    return (F.when(f.startswith("TA"), "air_temperature")
            .when(f.startswith("TS"), "soil_temperature")
            .when(f.startswith("SWC"), "soil_water")
            .when(f.startswith("RG"), "radiation")
            .when(f.startswith("P_lag") | (f == "precipitation_rate"), "precipitation")
            .when(f.contains("Snow") | f.isin("DSSM", "D_SNOW"), "snow")
            .when(f.isin("VPD_f", "RH"), "humidity")
            .when(f.contains("NDVI"), "vegetation")
            .when(f.contains("sin_doy"), "season_sin")
            .when(f.contains("cos_doy"), "season_cos")
            .otherwise("other"))


def standardise(df: DataFrame, features, fit_on: Column | None = None,
                by: tuple[str, ...] = ("site",)) -> DataFrame:
    """z-score each feature with the population std of the fitting rows.

    Fitted per group (``by``) on the rows where ``fit_on`` holds (train rows),
    applied to all rows.  A zero std divides by 1, as the scaler of the
    original pipeline does.  The statistics are one row per group and are
    broadcast once their row count is known to be small.
    """
    src = df.where(fit_on) if fit_on is not None else df
    stats = src.groupBy(*by).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    out = df.join(small_side(stats), list(by), "left")
    return out.withColumns({
        f: (F.col(f) - F.col(f"_m_{f}")) / F.coalesce(F.nullif(F.col(f"_s_{f}"), F.lit(0.0)), F.lit(1.0))
        for f in features
    }).drop(*[f"_m_{f}" for f in features], *[f"_s_{f}" for f in features])
