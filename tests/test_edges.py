"""Edge cases on hand-made fixtures: nulls, constants, calendar edges, errors."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns as FN
from panelspark.operators import attribution as A
from panelspark.operators import calendar as CAL
from panelspark.operators import correlate as COR
from panelspark.operators import evaluate as E
from panelspark.operators import prepare as P
from panelspark.operators import validate as V
from panelspark.plans.weekly import require_calendar


def test_dropna_removes_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (3.0, None)], "a double, b double")
    assert P.dropna_subset(df, ["a", "b"]).count() == 1
    assert P.dropna_subset(df, ["b"]).count() == 3


def test_leap_day_angle_exceeds_full_turn(spark):
    df = spark.createDataFrame([(dt.date(2000, 12, 31),), (dt.date(2000, 2, 29),)], "Date date")
    s, c = FN.cyclic_doy()
    rows = {r["Date"]: r for r in df.select("Date", s, c).collect()}
    ang = 2 * math.pi * 366 / 365
    assert abs(rows[dt.date(2000, 12, 31)]["sin_doy"] - math.sin(ang)) < 1e-12


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([("F", 1.0, 5.0, 2.0), ("F", 2.0, 5.0, 4.1), ("F", 3.0, 5.0, 5.9)],
                               "site string, y double, k double, x double")
    m = {(r["feature_a"], r["feature_b"]): r["r"] for r in COR.corr_matrix(df, "y", ["k", "x"]).collect()}
    assert m[("y", "k")] is None and m[("k", "k")] is None
    assert abs(m[("y", "y")] - 1.0) < 1e-12 and m[("y", "x")] > 0.99
    t = {r["Feature"]: r["Correlation"] for r in COR.corr_target(df, "y", ["k", "x"]).collect()}
    assert t["k"] is None


def test_r2_null_for_constant_or_single_row(spark):
    df = spark.createDataFrame([("F", "test", 2000, 1.0, 0.5), ("F", "test", 2001, 1.0, 0.7),
                                ("F", "test", 2001, 1.0, 0.9)],
                               "site string, split string, Year int, Observed_NEE double, Predicted_NEE double")
    rows = {r["Year"]: r for r in E.metrics_by_year(df).collect()}
    assert rows[2000]["r2"] is None and rows[2001]["r2"] is None
    assert rows[2000]["mae"] == pytest.approx(0.5)


def test_week_edges(spark):
    # Mon 2001-05-28 (week starts in May: dropped), Mon 2001-10-29 (starts in Oct, ends in Nov: kept)
    df = spark.createDataFrame([("F", dt.date(2001, 6, 1), 1.0), ("F", dt.date(2001, 11, 2), 2.0),
                                ("F", dt.date(2001, 6, 4), 3.0)], "site string, Date date, Predicted_NEE double")
    wk = P.filter_season_weeks(df.withColumn("week", P.week_start("Date")))
    got = sorted(r["week"] for r in wk.collect())
    assert got == [dt.date(2001, 6, 4), dt.date(2001, 10, 29)]


def test_calendar_and_grid_fill(spark):
    rows = [("F", dt.date(2001, 6, 4), 1.0, 0.5, -0.2), ("O", dt.date(2001, 6, 11), 2.0, -0.1, 0.3),
            ("F", dt.date(2002, 6, 3), 3.0, 0.2, 0.1)]
    full = spark.createDataFrame(rows, "site string, Date date, Predicted_NEE double, SHAP_a double, SHAP_b double")
    wide = CAL.weekly_wide(full, ["a", "b"])
    cal = CAL.season_calendar(wide)
    c = [(r["week"], r["ordinal"], r["year_change"]) for r in cal.orderBy("week").collect()]
    assert [x[1] for x in c] == [0, 1, 2] and [x[2] for x in c] == [False, False, True]
    chosen = spark.createDataFrame([("F", "a"), ("O", "b")], "site string, Feature string")
    grid = CAL.aligned_grid(CAL.weekly_shap_mean(wide, ["a", "b"]), CAL.weekly_nee_mean(wide), cal, chosen,
                            ("F", "O"), ["a", "b"])
    assert grid.count() == 3 * 2 * 2
    g = {(r["site"], r["week"], r["Feature"]): r for r in grid.collect()}
    assert g[("F", dt.date(2001, 6, 4), "b")]["mean_shap"] == 0.0          # feature chosen by the other site
    assert g[("O", dt.date(2001, 6, 4), "b")]["mean_shap"] == 0.0          # week missing for the site
    assert g[("O", dt.date(2001, 6, 4), "b")]["mean_nee"] is None          # target gap stays NULL
    st = {(r["site"], r["week"], r["Feature"]): r for r in CAL.stack_offsets(grid).collect()}
    assert st[("F", dt.date(2001, 6, 4), "b")]["pos_base"] == pytest.approx(0.5)


def test_empty_season_raises(spark):
    full = spark.createDataFrame([("F", dt.date(2001, 1, 1), 1.0, 0.5)],
                                 "site string, Date date, Predicted_NEE double, SHAP_a double")
    with pytest.raises(ValueError):
        require_calendar(CAL.season_calendar(CAL.weekly_wide(full, ["a"])))


def test_top_n_larger_than_features(spark):
    long = spark.createDataFrame([("F", "a", 1.0), ("F", "sin_doy", 5.0), ("F", "b", -2.0)],
                                 "site string, Feature string, shap double")
    top = {r["Feature"]: r["rank"] for r in A.top_n_shap(long, 10).collect()}
    assert top == {"b": 1, "a": 2}
    assert len(A.top_n_shap(long, None).collect()) == 3


def test_one_year_folds_raise(spark):
    df = spark.createDataFrame([("F", dt.date(2001, 1, d), 2001) for d in range(1, 5)],
                               "site string, Date date, Year int")
    with pytest.raises(Exception):
        V.cv_group_folds(df).collect()


def test_single_row_stratum_raises(spark):
    pan = spark.createDataFrame([("F", dt.date(2001, 1, 1), 1.0), ("F", dt.date(2002, 1, 1), 1.0),
                                 ("F", dt.date(2002, 1, 2), 1.0)], "site string, Date date, NEE_U50_f double")
    with pytest.raises(Exception):
        V.split_keys(pan).collect()


def test_family_rules(spark):
    names = ["TA_lag7d", "TS_10cm", "SWC_lag14d", "RG_min", "P_lag7d", "precipitation_rate", "DSSM",
             "Snow_Cover_Percentage", "VPD_f", "NDVI_nonSR_Max", "sin_doy", "cos_doy", "zzz"]
    df = spark.createDataFrame([(f"SHAP_{n}",) for n in names], "Feature string")
    fam = {r["Feature"]: r["family"] for r in A.with_family(df).collect()}
    assert fam["SHAP_TA_lag7d"] == "air_temperature" and fam["SHAP_P_lag7d"] == "precipitation"
    assert fam["SHAP_DSSM"] == "snow" and fam["SHAP_VPD_f"] == "humidity" and fam["SHAP_zzz"] == "other"
    assert fam["SHAP_sin_doy"] == "season_sin" and fam["SHAP_cos_doy"] == "season_cos"


def test_histogram_constant_residual_fills_the_first_bin(spark):
    df = spark.createDataFrame([("F", "test", 1.0, 0.5)] * 4,
                               "site string, split string, Observed_NEE double, Predicted_NEE double")
    h = {r["bin"]: r["n"] for r in E.residual_histogram(df).collect()}
    assert len(h) == 50 and h[0] == 4 and sum(h.values()) == 4


def test_rankings_use_raw_values(spark):
    """Attributions around 1e-7 rank by size, not by name."""
    long = spark.createDataFrame([("F", "a", 1e-9), ("F", "b", -4e-7), ("F", "c", 1e-7)],
                                 "site string, Feature string, shap double")
    assert [r["Feature"] for r in A.top_n_shap(long, 1).collect()] == ["b"]
    assert {r["Feature"]: r["rank"] for r in A.shap_summary(long).collect()} == {"b": 1, "c": 2, "a": 3}
    target = spark.createDataFrame([("F", "a", 1e-9), ("F", "b", 3e-8)], "site string, Feature string, Correlation double")
    top = COR.corr_top_bottom(target, 1).where("end = 'top'").collect()
    assert [r["Feature"] for r in top] == ["b"]


def test_pick_quantile_slots(spark):
    df = spark.createDataFrame([("F", dt.date(2001, 1, d), float(d)) for d in range(1, 10)],
                               "site string, Date date, Predicted_NEE double")
    picks = sorted((r["quantile_slot"], r["Predicted_NEE"]) for r in V.pick_quantile_rows(df).collect())
    assert picks == [(1, 1.0), (2, 4.0), (3, 7.0), (4, 9.0)]


def test_pick_quantile_ties_resolve_by_date(spark):
    df = spark.createDataFrame([("F", dt.date(2001, 1, d), 1.0) for d in (5, 3, 4, 1, 2, 6)],
                               "site string, Date date, Predicted_NEE double")
    picks = sorted((r["quantile_slot"], r["Date"]) for r in V.pick_quantile_rows(df).collect())
    assert picks == [(1, dt.date(2001, 1, 1)), (2, dt.date(2001, 1, 3)), (3, dt.date(2001, 1, 5)),
                     (4, dt.date(2001, 1, 6))]
