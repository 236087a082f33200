"""Weekly calendar operators: weekly means, season calendar, aligned grid, stacks.

Plan shape: one wide aggregate per (site, week) over the row data (partial
aggregation map-side, one shuffle keyed on site and week), then everything
else runs on the aggregated table, whose size is sites x weeks x features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .prepare import filter_season_weeks, week_start


def nee_column(df: DataFrame) -> str:
    """The predicted target when the table has it, else the observed one."""
    return "Predicted_NEE" if "Predicted_NEE" in df.columns else "Observed_NEE"


def weekly_sums(df: DataFrame, features) -> DataFrame:
    """Per (site, week) of all weeks: row count, target mean and, per feature, the sums and counts of SHAP and |SHAP|.

    The one pass over the rows: the top features, the calendar and the grid
    all follow from this small table, so callers keep it (``cut_lineage``).
    """
    nee = nee_column(df)
    return df.withColumn("week", week_start("Date")).groupBy("site", "week").agg(
        *[F.sum(f"SHAP_{f}").alias(f"_sum_{f}") for f in features],
        *[F.sum(F.abs(f"SHAP_{f}")).alias(f"_abs_{f}") for f in features],
        *[F.count(f"SHAP_{f}").alias(f"_n_{f}") for f in features], F.avg(nee).alias("nee"))


def mean_abs_shap(sums: DataFrame, features) -> DataFrame:
    """(site, Feature, mean_abs_shap) over all weeks, from ``weekly_sums``."""
    total = sums.groupBy("site").agg(*[(F.sum(f"_abs_{f}") / F.nullif(F.sum(f"_n_{f}"), F.lit(0))).alias(f) for f in features])
    return total.select("site", F.inline(F.array(*[
        F.struct(F.lit(f).alias("Feature"), F.col(f).alias("mean_abs_shap")) for f in features])))


def weekly_wide(df: DataFrame, features, season: bool = True) -> DataFrame:
    """Per (site, week): mean of every SHAP column and of the target column."""
    return weekly_means(weekly_sums(df, features), features, season)


def weekly_means(sums: DataFrame, features, season: bool = True) -> DataFrame:
    wk = filter_season_weeks(sums) if season else sums
    return wk.select("site", "week", *[(F.col(f"_sum_{f}") / F.nullif(F.col(f"_n_{f}"), F.lit(0))).alias(f"SHAP_{f}")
                                       for f in features], "nee")


def weekly_shap_mean(wide: DataFrame, features) -> DataFrame:
    """Long (site, week, Feature, mean_shap) from the weekly wide table."""
    entries = [F.struct(F.lit(f).alias("Feature"), F.col(f"SHAP_{f}").alias("mean_shap")) for f in features]
    return wide.select("site", "week", F.inline(F.array(*entries)))


def weekly_nee_mean(wide: DataFrame) -> DataFrame:
    return wide.select("site", "week", F.col("nee").alias("mean_nee"))


def season_calendar(weeks: DataFrame) -> DataFrame:
    """Union of season weeks over sites: ordinal, year, month, year-change flag.

    Runs on the distinct-week table (one row per week), so the global
    ordering window touches a few hundred rows at most per decade.
    """
    cal = filter_season_weeks(weeks.select("week").distinct())
    w = Window.orderBy("week")
    return cal.select(
        "week",
        (F.row_number().over(w) - 1).alias("ordinal"),
        F.year("week").alias("year"),
        F.month("week").alias("month"),
        F.coalesce(F.year("week") != F.lag(F.year("week")).over(w), F.lit(False)).alias("year_change"),
    )


def calendar_months(calendar: DataFrame) -> DataFrame:
    """Distinct (year, month) of the calendar (month label positions)."""
    return calendar.groupBy("year", "month").agg(
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


def aligned_grid(weekly_long: DataFrame, nee: DataFrame, calendar: DataFrame,
                 chosen: DataFrame, sites, features) -> DataFrame:
    """Every site x calendar week x chosen feature (union over sites).

    A feature a site did not choose, or a week it has no data for, gets
    SHAP 0; the weekly target stays NULL where the site has no rows.
    The grid is generated from the calendar by exploding the configured
    sites and features (bounded lists), then restricted to the chosen union
    by an equi semi join - it has exactly the output's size.
    """
    union = chosen.select("Feature").distinct()
    grid = (calendar.select("week", "ordinal", F.explode(F.array(*[F.lit(s) for s in sites])).alias("site"))
            .select("site", "week", "ordinal",
                    F.explode(F.array(*[F.lit(f) for f in features])).alias("Feature"))
            .join(union, "Feature", "left_semi"))
    picked = weekly_long.join(chosen.select("site", "Feature"), ["site", "Feature"], "left_semi")
    return (grid.join(picked, ["site", "week", "Feature"], "left")
            .join(nee, ["site", "week"], "left")
            .select("site", "week", "ordinal", "Feature",
                    F.coalesce("mean_shap", F.lit(0.0)).alias("mean_shap"), "mean_nee"))


def stack_offsets(grid: DataFrame) -> DataFrame:
    """Running base of each feature's positive and negative bar (feature-name order)."""
    w = (Window.partitionBy("site", "week").orderBy("Feature")
         .rowsBetween(Window.unboundedPreceding, -1))
    pos, neg = F.greatest("mean_shap", F.lit(0.0)), F.least("mean_shap", F.lit(0.0))
    return grid.withColumns({
        "pos": pos, "neg": neg,
        "pos_base": F.coalesce(F.sum(pos).over(w), F.lit(0.0)),
        "neg_base": F.coalesce(F.sum(neg).over(w), F.lit(0.0)),
    })


def weekly_signed_sums(grid: DataFrame) -> DataFrame:
    """Per (site, week): sum of positive and of negative mean SHAP, target mean."""
    return grid.groupBy("site", "week").agg(
        F.sum(F.greatest("mean_shap", F.lit(0.0))).alias("pos_sum"),
        F.sum(F.least("mean_shap", F.lit(0.0))).alias("neg_sum"),
        F.first("mean_nee", ignorenulls=True).alias("mean_nee"))


def weekly_bounds(sums: DataFrame, pad: float = 1.05) -> DataFrame:
    """Per site: axis range from the signed sums and the target (5 % padding)."""
    return sums.groupBy("site").agg(
        (F.greatest(F.max("pos_sum"), F.coalesce(F.max("mean_nee"), F.lit(0.0))) * F.lit(pad)).alias("y_max"),
        (F.least(F.min("neg_sum"), F.coalesce(F.min("mean_nee"), F.lit(0.0)), F.lit(0.0)) * F.lit(pad))
        .alias("y_min"))
