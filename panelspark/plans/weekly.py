"""Weekly multi-site attribution calendar and observed/predicted series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import attribution as A
from ..operators import calendar as CAL
from ..operators.ordering import as_is
from ..session import cut_lineage


def weekly_tables(full: DataFrame, features, sites=None, top_n: int | None = C.TOP_N_WEEKLY,
                  order_key=as_is) -> dict[str, DataFrame]:
    """From full-data predictions + SHAP columns of all sites to the aligned weekly tables.

    One aggregate per (site, week) over the rows; the top features, the
    calendar, the aligned grid (zero-filled SHAP, NULL target gaps), stack
    offsets, sums and bounds follow from it. ``sites=None``: those of the data.
    """
    features = list(features)
    weekly = cut_lineage(CAL.weekly_sums(full, features))
    if sites is None:
        sites = sorted(r["site"] for r in weekly.select("site").distinct().collect())
    wide = CAL.weekly_means(weekly, features)
    chosen = A.rank_features(CAL.mean_abs_shap(weekly, [f for f in features if top_n is None or f not in C.SEASONAL]),
                             top_n, order_key=order_key)
    calendar = CAL.season_calendar(wide)
    grid = CAL.aligned_grid(CAL.weekly_shap_mean(wide, features), CAL.weekly_nee_mean(wide),
                            calendar, chosen, sites, features)
    sums = CAL.weekly_signed_sums(grid)
    return {
        "calendar": calendar,
        "months": CAL.calendar_months(calendar),
        "chosen": chosen,
        "grid": grid,
        "stacked": CAL.stack_offsets(grid),
        "sums": sums,
        "bounds": CAL.weekly_bounds(sums),
    }


def require_calendar(calendar: DataFrame) -> DataFrame:
    """Raise when no week falls in the season (the chart would be empty)."""
    if calendar.isEmpty():
        raise ValueError("No weekly periods found for the season calendar.")
    return calendar


def observed_predicted_series(full: DataFrame) -> DataFrame:
    """(site, Date, observed, predicted) without gaps, in date order per site."""
    return (full.select("site", "Date", "Observed_NEE", "Predicted_NEE")
            .dropna(subset=["Date", "Observed_NEE", "Predicted_NEE"]).orderBy("site", "Date"))
