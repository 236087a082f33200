"""Projections, filters and reshaping of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import with_cyclic_doy, with_date_parts


def period_predicate(period: str) -> Column | None:
    """Row rule of a period: the field season is June to October."""
    if period in ("", None):
        return None
    if period in ("fieldseason", "_fieldseason", "GS", "_GS"):
        return F.month("Date").between(*(C.SEASON_MONTHS[0], C.SEASON_MONTHS[-1]))
    raise ValueError(f"unknown period {period!r}")


def scan_by_site_period(panel: DataFrame, sites=None, period: str = "") -> DataFrame:
    """Select sites and a period from the one all-site panel (pushed to the scan)."""
    out = panel
    if sites:
        out = out.where(F.col("site").isin(*sites))
    pred = period_predicate(period)
    return out if pred is None else out.where(pred)


def dropna_subset(df: DataFrame, cols) -> DataFrame:
    """Drop rows with NULL or NaN in any listed column.

    One predicate over an array: dozens of separate not-null predicates below
    aliasing projections make the optimizer's constraint inference explode.
    """
    values = F.array(*[F.col(c).cast("double") for c in cols])
    return df.where(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x)))


def prepare(panel: DataFrame, features, target: str = C.TARGET) -> DataFrame:
    """Seasonal angle, complete-case filter, date parts (the per-stage preparation)."""
    df = with_cyclic_doy(panel)
    df = dropna_subset(df, [target] + list(features))
    return with_date_parts(df)


def project_features(df: DataFrame, features, target: str = C.TARGET,
                     keys=("site", "Date")) -> DataFrame:
    """Keys, ordered features and the target (X, y and groups stay in one row)."""
    extra = [c for c in ("Year",) if c in df.columns]
    return df.select(*keys, *extra, *features, target)


def shap_long(df: DataFrame, keys=("site", "Date"), prefix: str = "SHAP_") -> DataFrame:
    """Wide ``SHAP_<f>`` columns to long (keys..., Feature, shap)."""
    shap_cols = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(list(keys), shap_cols, "Feature", "shap")
    return long.withColumn("Feature", F.regexp_replace("Feature", f"^{prefix}", ""))


def week_start(date="Date") -> Column:
    """Monday of the (Monday to Sunday) week holding the date."""
    d = F.col(date) if isinstance(date, str) else date
    return F.date_trunc("week", d).cast("date")


def filter_season_weeks(df: DataFrame, week: str = "week") -> DataFrame:
    """Keep weeks whose Monday lies in June to October."""
    return df.where(F.month(week).between(C.SEASON_MONTHS[0], C.SEASON_MONTHS[-1]))
