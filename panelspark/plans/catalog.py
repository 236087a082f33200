"""Registered queries: one per operator, each over the given tables.

``QUERIES[name](spark, sf_dir)`` returns a lazy DataFrame; ``SQL[name]`` is
the independent DuckDB statement computing the same rows (absent for
model-dependent operators, which are checked by invariants instead).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from .. import oracle as O
from ..functions import columns as FN
from ..operators import attribution as A
from ..operators import calendar as CAL
from ..operators import correlate as COR
from ..operators import evaluate as E
from ..operators import prepare as P
from ..operators import validate as V
from ..operators.standin import standin_predict
from ..session import cut_lineage, scratch_path
from ..sources import files as FS
from .finish import finish, r, rank_key
from .frames import panel, prepared, standin_frame

S12 = list(C.S12)
RAW = C.PANEL_INPUTS
# stddev_samp differs between engines in the last bits: the one raw column reported rounded
RAW_EXACT = [c for c in RAW if c != "VPD_f"]

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------
# metrics_by_year: the minimum end-to-end slice
# --------------------------------------------------------------------------
_MBY_SQL = O.standin_ctes() + f"""
SELECT site, Year, count(*) AS n,
  {r("1 - sum((Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE)) / nullif(var_pop(Observed_NEE) * count(*), 0)", "r2")},
  {r("sqrt(avg((Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE)))", "rmse")},
  {r("avg(abs(Observed_NEE - Predicted_NEE))", "mae")}
FROM standin WHERE split = 'test' GROUP BY site, Year
"""


@register("metrics_by_year", _MBY_SQL)
def q_metrics_by_year(spark, sf_dir):
    return finish(E.metrics_by_year(standin_frame(spark, sf_dir)))


# --------------------------------------------------------------------------
# shared SQL pieces
# --------------------------------------------------------------------------
STANDIN = O.standin_ctes()
_H43 = "md5('43|' || site || '|' || CAST(Date AS VARCHAR))"
SAMPLE_CTE = f""",
sample AS (
  SELECT * FROM standin WHERE split = 'test'
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY {_H43}, Date) <= {C.SHAP_SAMPLE}
)"""


def _unnest_long(src: str, features, keys=("site", "Date"), value: bool = True) -> str:
    names = ", ".join(f"'{f}'" for f in features)
    shap = ", ".join(f"SHAP_{f}" for f in features)
    vals = ", ".join(f"CAST({f} AS DOUBLE)" for f in features)
    vsql = f", unnest([{vals}]) AS value" if value else ""
    return (f"SELECT {', '.join(keys)}, unnest([{names}]) AS Feature{vsql}, "
            f"unnest([{shap}]) AS shap FROM {src}")


def _rr(cols) -> str:
    return ", ".join(r(c, c) for c in cols)


def _metric_sql(y: str, p: str, prefix: str = "") -> str:
    e = f"({y} - {p})"
    return (f"count({e}) AS {prefix}n, "
            + r(f"1 - sum({e} * {e}) / nullif(var_pop({y}) * count({e}), 0)", f"{prefix}r2") + ", "
            + r(f"sqrt(avg({e} * {e}))", f"{prefix}rmse") + ", "
            + r(f"avg(abs({e}))", f"{prefix}mae"))


def _sample(spark, sf_dir):
    return V.sample_test_rows(standin_frame(spark, sf_dir).where(F.col("split") == "test"))


def _test_long(spark, sf_dir):
    return A.shap_values_long(standin_frame(spark, sf_dir).where(F.col("split") == "test"), S12)


# --------------------------------------------------------------------------
# 2.1 scans, sources, sinks
# --------------------------------------------------------------------------
def _written_panel(spark, sf_dir, period=""):
    base = scratch_path(spark, "site-csv")
    FS.write_site_csvs(panel(spark, sf_dir), base, period)
    return base


_PANEL_ROUNDED = "* EXCLUDE (VPD_f), " + r("VPD_f", "VPD_f")


@register("scan_panel", O.with_(O.panel_cte())
          + f" SELECT {_PANEL_ROUNDED.replace('* EXCLUDE (VPD_f)', '* EXCLUDE (VPD_f, site)')} FROM panel WHERE site = 'F'")
def q_scan_panel(spark, sf_dir):
    base = _written_panel(spark, sf_dir)
    return finish(FS.scan_panel(spark, FS.site_path(base, "F"), columns=RAW), keep_exact=RAW_EXACT)


@register("scan_multi_site", O.with_(O.panel_cte()) + f" SELECT {_PANEL_ROUNDED} FROM panel")
def q_scan_multi_site(spark, sf_dir):
    base = _written_panel(spark, sf_dir)
    return finish(FS.scan_multi_site(spark, base, columns=RAW), keep_exact=RAW_EXACT)


@register("scan_by_site_period", O.with_(O.panel_cte())
          + f" SELECT {_PANEL_ROUNDED} FROM panel WHERE site = 'O' AND month(Date) BETWEEN 6 AND 10")
def q_scan_by_site_period(spark, sf_dir):
    return finish(P.scan_by_site_period(panel(spark, sf_dir), sites=["O"], period="fieldseason"),
                  keep_exact=RAW_EXACT)


_PRED_EXPORT_SQL_BODY = (
    "SELECT site, Date, " + _rr(["Observed_NEE", "Predicted_NEE"]) + ", "
    + r("Observed_NEE - Predicted_NEE", "Residual") + ", " + r("abs(Observed_NEE - Predicted_NEE)", "Abs_Residual")
    + ", " + ", ".join(f"{f} AS {f}" if f not in C.SEASONAL else r(f, f) for f in S12)
    + " FROM standin WHERE split = 'test'")


def _pred_export(spark, sf_dir):
    return finish(E.predictions_export(standin_frame(spark, sf_dir), S12),
                  keep_exact=[f for f in S12 if f not in C.SEASONAL])


@register("sink_table", STANDIN + " " + _PRED_EXPORT_SQL_BODY)
def q_sink_table(spark, sf_dir):
    df = _pred_export(spark, sf_dir)
    path = FS.sink_table(df, scratch_path(spark, "sink"), "csv", partition_by=["site"])
    back = spark.read.schema(df.drop("site").schema).option("header", True).csv(path)
    return back.select("site", *[c for c in df.columns if c != "site"]) if "site" in back.columns else back


# --------------------------------------------------------------------------
# 2.2 projections, filters
# --------------------------------------------------------------------------
@register("project_features", O.with_(O.panel_cte(), O.prepared_cte(S12)) + f"""
SELECT site, Date, Year, {', '.join(f if f not in C.SEASONAL else r(f, f) for f in S12)}, {C.TARGET}
FROM prep""")
def q_project_features(spark, sf_dir):
    pre = P.prepare(panel(spark, sf_dir), S12)
    return finish(P.project_features(pre, S12), keep_exact=[f for f in S12 if f not in C.SEASONAL] + [C.TARGET])


@register("dropna_subset", O.with_(O.panel_cte(), O.prepared_cte(C.P34))
          + f" SELECT site, Date, {C.TARGET} FROM prep")
def q_dropna_subset(spark, sf_dir):
    pre = P.prepare(panel(spark, sf_dir), C.P34)
    return pre.select("site", "Date", C.TARGET)


@register("filter_season_weeks", STANDIN + """,
wk AS (SELECT *, CAST(date_trunc('week', Date) AS DATE) AS week FROM standin)
SELECT site, week, count(*) AS n_days, """ + r("avg(Predicted_NEE)", "mean_nee") + """
FROM wk WHERE month(week) BETWEEN 6 AND 10 GROUP BY site, week""")
def q_filter_season_weeks(spark, sf_dir):
    wk = standin_frame(spark, sf_dir).withColumn("week", P.week_start("Date"))
    return finish(P.filter_season_weeks(wk).groupBy("site", "week")
                  .agg(F.count("*").alias("n_days"), F.avg("Predicted_NEE").alias("mean_nee")))


@register("shap_long", STANDIN + ",\nlong AS (" + _unnest_long("standin", S12, value=False) + ")\n"
          "SELECT site, Date, Feature, " + r("shap", "shap") + " FROM long")
def q_shap_long(spark, sf_dir):
    wide = standin_frame(spark, sf_dir).select("site", "Date", *[f"SHAP_{f}" for f in S12])
    return finish(P.shap_long(wide))


# --------------------------------------------------------------------------
# 2.3 joins and alignment
# --------------------------------------------------------------------------
@register("align_predictions", STANDIN + " SELECT site, Date, split, " + _rr(["Observed_NEE", "Predicted_NEE"])
          + " FROM standin")
def q_align_predictions(spark, sf_dir):
    return finish(standin_frame(spark, sf_dir).select("site", "Date", "split", "Observed_NEE", "Predicted_NEE"))


_FULL_COLS = ("site, Date, Year, Month, " + _rr(["Observed_NEE", "Predicted_NEE"]) + ", "
              + r("Observed_NEE - Predicted_NEE", "Residual") + ", "
              + r("abs(Observed_NEE - Predicted_NEE)", "Abs_Residual") + ", "
              + _rr([f"SHAP_{f}" for f in S12]))


@register("align_shap_wide", STANDIN + f" SELECT {_FULL_COLS} FROM standin")
def q_align_shap_wide(spark, sf_dir):
    return finish(A.shap_export_full(standin_frame(spark, sf_dir), S12))


def _metrics_compare_sql() -> str:
    small = S12[:6]
    from ..operators.standin import standin_sql
    ctes = O.with_(O.panel_cte(), O.split_cte(), O.prepared_cte(S12),
                   "prep_split AS (SELECT p.*, s.split FROM prep p JOIN split s USING (site, Date))",
                   standin_sql(S12, C.TARGET, "prep_split", "m2"),
                   standin_sql(small, C.TARGET, "prep_split", "m1"))
    return ctes + """,
both_m AS (
  SELECT site, split, Observed_NEE, Predicted_NEE, 1 AS stage FROM m1
  UNION ALL SELECT site, split, Observed_NEE, Predicted_NEE, 2 AS stage FROM m2
),
wide AS (
  SELECT site,
    1 - sum(CASE WHEN stage = 1 THEN (Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE) END)
      / nullif(var_pop(CASE WHEN stage = 1 THEN Observed_NEE END) * count(CASE WHEN stage = 1 THEN 1 END), 0) AS s1_r2,
    1 - sum(CASE WHEN stage = 2 THEN (Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE) END)
      / nullif(var_pop(CASE WHEN stage = 2 THEN Observed_NEE END) * count(CASE WHEN stage = 2 THEN 1 END), 0) AS s2_r2,
    sqrt(avg(CASE WHEN stage = 1 THEN (Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE) END)) AS s1_rmse,
    sqrt(avg(CASE WHEN stage = 2 THEN (Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE) END)) AS s2_rmse,
    avg(CASE WHEN stage = 1 THEN abs(Observed_NEE - Predicted_NEE) END) AS s1_mae,
    avg(CASE WHEN stage = 2 THEN abs(Observed_NEE - Predicted_NEE) END) AS s2_mae
  FROM both_m WHERE split = 'test' GROUP BY site
)
SELECT site, 'R2' AS Metric, """ + _rr_pair("s1_r2", "s2_r2", "s2_r2 - s1_r2") + """ FROM wide
UNION ALL SELECT site, 'RMSE', """ + _rr_pair("s1_rmse", "s2_rmse", "-1e0 * (s2_rmse - s1_rmse)") + """ FROM wide
UNION ALL SELECT site, 'MAE', """ + _rr_pair("s1_mae", "s2_mae", "-1e0 * (s2_mae - s1_mae)") + " FROM wide"


def _rr_pair(a, b, imp):
    return r(a, "Stage1") + ", " + r(b, "Stage2") + ", " + r(imp, "Improvement")


@register("metrics_compare", _metrics_compare_sql())
def q_metrics_compare(spark, sf_dir):
    rows = prepared(spark, sf_dir, S12)
    first = standin_predict(rows, S12[:6], C.TARGET)
    second = standin_predict(rows, S12, C.TARGET)
    return finish(E.metrics_compare(first, second))


# --------------------------------------------------------------------------
# 2.4 aggregations
# --------------------------------------------------------------------------
@register("metrics_overall", STANDIN + """
SELECT site, """ + ", ".join(
    _metric_sql(f"CASE WHEN split = '{s}' THEN Observed_NEE END", f"CASE WHEN split = '{s}' THEN Predicted_NEE END",
                f"{s}_") for s in ("train", "test")) + ", "
    + r("(1 - sum(CASE WHEN split = 'train' THEN (Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE) END)"
        " / nullif(var_pop(CASE WHEN split = 'train' THEN Observed_NEE END) * count(CASE WHEN split = 'train' THEN 1 END), 0))"
        " - (1 - sum(CASE WHEN split = 'test' THEN (Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE) END)"
        " / nullif(var_pop(CASE WHEN split = 'test' THEN Observed_NEE END) * count(CASE WHEN split = 'test' THEN 1 END), 0))",
        "r2_gap")
    + """,
  CASE WHEN (1 - sum(CASE WHEN split = 'train' THEN (Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE) END)
        / nullif(var_pop(CASE WHEN split = 'train' THEN Observed_NEE END) * count(CASE WHEN split = 'train' THEN 1 END), 0))
      - (1 - sum(CASE WHEN split = 'test' THEN (Observed_NEE - Predicted_NEE) * (Observed_NEE - Predicted_NEE) END)
        / nullif(var_pop(CASE WHEN split = 'test' THEN Observed_NEE END) * count(CASE WHEN split = 'test' THEN 1 END), 0))
      > 0.15 THEN 'check overfitting' ELSE 'acceptable' END AS overfit_check
FROM standin GROUP BY site""")
def q_metrics_overall(spark, sf_dir):
    return finish(E.metrics_overall(standin_frame(spark, sf_dir)))


def _metrics_export_sql() -> str:
    def side(split, metric):
        y, q = f"CASE WHEN split = '{split}' THEN Observed_NEE END", f"CASE WHEN split = '{split}' THEN Predicted_NEE END"
        e = f"({y} - {q})"
        return {"R²": f"1 - sum({e} * {e}) / nullif(var_pop({y}) * count({e}), 0)", "RMSE": f"sqrt(avg({e} * {e}))",
                "MAE": f"avg(abs({e}))"}[metric]
    return STANDIN + " " + " UNION ALL ".join(
        f"SELECT site, '{m}' AS Metric, {r(side('train', m), 'Training')}, {r(side('test', m), 'Test')}, "
        + ("12e0" if m == "R²" else "CAST(NULL AS DOUBLE)") + " AS N_Features FROM standin GROUP BY site"
        for m in ("R²", "RMSE", "MAE"))


@register("metrics_export", _metrics_export_sql())
def q_metrics_export(spark, sf_dir):
    """The exported layout of a model's metrics (one row per metric, extra columns on the R² row)."""
    overall = E.metrics_overall(standin_frame(spark, sf_dir))
    return finish(E.metrics_table(overall, {"N_Features": F.lit(float(len(S12)))}))


@register("panel_profile", O.with_(O.panel_cte(), O.prepared_cte(S12)) + """,
py AS (SELECT site, Year, count(*) AS n_rows, min(Date) AS first_date, max(Date) AS last_date FROM prep GROUP BY site, Year)
SELECT site, Year, n_rows, first_date, last_date,
  CAST(sum(n_rows) OVER (PARTITION BY site) AS BIGINT) AS site_rows,
  min(first_date) OVER (PARTITION BY site) AS site_first_date,
  max(last_date) OVER (PARTITION BY site) AS site_last_date,
  CAST(count(*) OVER (PARTITION BY site) AS BIGINT) AS site_years
FROM py""")
def q_panel_profile(spark, sf_dir):
    from ..operators.profile import panel_profile
    return panel_profile(P.prepare(panel(spark, sf_dir), S12))


@register("residual_profile", STANDIN + """
SELECT site, split, count(*) AS n, """ + r("min(Observed_NEE)", "obs_min") + ", " + r("max(Observed_NEE)", "obs_max")
          + ", " + r("avg(Observed_NEE - Predicted_NEE)", "mean_residual") + " FROM standin GROUP BY site, split")
def q_residual_profile(spark, sf_dir):
    return finish(E.residual_profile(standin_frame(spark, sf_dir)))


@register("residual_histogram", STANDIN + """,
res AS (SELECT site, split, Observed_NEE - Predicted_NEE AS r FROM standin),
rng AS (SELECT site, split, min(r) AS r_min, max(r) AS r_max FROM res GROUP BY site, split),
binned AS (
  SELECT res.site, res.split, res.r, rng.r_min, (rng.r_max - rng.r_min) / 50e0 AS w,
         CAST(CASE WHEN (rng.r_max - rng.r_min) / 50e0 = 0 THEN 0
              ELSE least(floor((res.r - rng.r_min) / ((rng.r_max - rng.r_min) / 50e0)), 49) END AS INTEGER) AS bin
  FROM res JOIN rng USING (site, split)
)
SELECT g.site, g.split, CAST(g.bin AS INTEGER) AS bin, count(b.bin) AS n, """ + r("any_value(g.r_min + g.bin * g.w)", "bin_lo") + ", "
          + r("any_value(g.r_min + (g.bin + 1) * g.w)", "bin_hi") + """
FROM (SELECT site, split, r_min, (r_max - r_min) / 50e0 AS w, unnest(range(50)) AS bin FROM rng) g
LEFT JOIN binned b ON b.site = g.site AND b.split = g.split AND b.bin = g.bin GROUP BY g.site, g.split, g.bin""")
def q_residual_histogram(spark, sf_dir):
    return finish(E.residual_histogram(standin_frame(spark, sf_dir)))


# --------------------------------------------------------------------------
# correlation study (full period, complete on target + 32 predictors)
# --------------------------------------------------------------------------
C32 = list(C.C32)
_CORR_COLS = [C.TARGET] + C32
_CORR_BASE = O.with_(O.panel_cte(), O.prepared_cte(C32))


def _corr_frame(spark, sf_dir):
    return P.prepare(panel(spark, sf_dir), C32)


def _corr_agg_sql(cols, pairs) -> str:
    sds = ", ".join(f"stddev_pop({c}) AS _s_{c}" for c in cols)
    covs = ", ".join(f"covar_pop({a}, {b}) AS _c_{a}__{b}" for a, b in pairs)
    return f"corr_agg AS (SELECT site, {sds}, {covs} FROM prep GROUP BY site)"


def _corr_long_sql(cols, ordered_pairs, key) -> str:
    """unnest the (a, b, r) triples of the aggregate row; key(a, b) names the covariance."""
    fa = ", ".join(f"'{a}'" for a, _ in ordered_pairs)
    fb = ", ".join(f"'{b}'" for _, b in ordered_pairs)
    ia = ", ".join(str(cols.index(a)) for a, _ in ordered_pairs)
    ib = ", ".join(str(cols.index(b)) for _, b in ordered_pairs)
    rs = ", ".join(f"{key(a, b)} / nullif(_s_{a} * _s_{b}, 0)" for a, b in ordered_pairs)
    return (f"corr_long AS (SELECT site, unnest([{fa}]) AS feature_a, unnest([{fb}]) AS feature_b, "
            f"unnest([{ia}]) AS idx_a, unnest([{ib}]) AS idx_b, unnest([{rs}]) AS r FROM corr_agg)")


def _cov_key(cols):
    def key(a, b):
        if a == b:
            return f"(_s_{a} * _s_{a})"
        i, j = sorted((cols.index(a), cols.index(b)))
        return f"_c_{cols[i]}__{cols[j]}"
    return key


def _matrix_sql() -> str:
    cols = _CORR_COLS
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    ordered = [(a, b) for a in cols for b in cols]
    return (_CORR_BASE + ",\n" + _corr_agg_sql(cols, pairs) + ",\n" + _corr_long_sql(cols, ordered, _cov_key(cols))
            + "\nSELECT site, feature_a, feature_b, " + r("r", "r") + " FROM corr_long")


@register("corr_matrix", _matrix_sql())
def q_corr_matrix(spark, sf_dir):
    return finish(COR.corr_matrix(_corr_frame(spark, sf_dir), C.TARGET, C32))


def _target_sql_cte() -> str:
    cols = _CORR_COLS
    pairs = [(C.TARGET, f) for f in C32]
    ordered = [(C.TARGET, f) for f in C32]
    return (_CORR_BASE + ",\n" + _corr_agg_sql(cols, pairs) + ",\n"
            + _corr_long_sql(cols, ordered, lambda a, b: f"_c_{a}__{b}") + """,
tc AS (
  SELECT site, feature_b AS Feature, r AS Correlation,
    CAST(row_number() OVER (PARTITION BY site ORDER BY round(r * 1e6) DESC NULLS LAST, feature_b) AS INTEGER) AS rank,
    CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign
  FROM corr_long
)""")


@register("corr_target", _target_sql_cte() + "\nSELECT site, Feature, " + r("Correlation", "Correlation")
          + ", rank, sign FROM tc")
def q_corr_target(spark, sf_dir):
    return finish(COR.corr_target(_corr_frame(spark, sf_dir), C.TARGET, C32, order_key=rank_key))


@register("corr_top_bottom10", _target_sql_cte() + """
SELECT site, 'top' AS "end", rank AS position, Feature, """ + r("Correlation", "Correlation") + """ FROM tc WHERE rank <= 10
UNION ALL
SELECT site, 'bottom', CAST(row_number() OVER (PARTITION BY site ORDER BY round(Correlation * 1e6) ASC NULLS LAST, Feature DESC) AS INTEGER),
  Feature, """ + r("Correlation", "Correlation") + """ FROM tc
QUALIFY row_number() OVER (PARTITION BY site ORDER BY round(Correlation * 1e6) ASC NULLS LAST, Feature DESC) <= 10""")
def q_corr_top_bottom10(spark, sf_dir):
    return finish(COR.corr_top_bottom(COR.corr_target(_corr_frame(spark, sf_dir), C.TARGET, C32, order_key=rank_key), 10,
                                      order_key=rank_key))


def _high_sql() -> str:
    cols = C32
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return (_CORR_BASE + ",\n" + _corr_agg_sql(cols, pairs) + ",\n"
            + _corr_long_sql(cols, pairs, _cov_key(cols)) + """
SELECT site, feature_a AS feature_1, feature_b AS feature_2, """ + r("r", "r") + """,
  CAST(row_number() OVER (PARTITION BY site ORDER BY round(abs(r) * 1e6) DESC, idx_a, idx_b) AS INTEGER) AS rank
FROM corr_long WHERE abs(r) > 0.8""")


@register("corr_high_pairs", _high_sql())
def q_corr_high_pairs(spark, sf_dir):
    return finish(COR.corr_high_pairs(_corr_frame(spark, sf_dir), C32, order_key=rank_key))


def _study_sql() -> str:
    cols = _CORR_COLS
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    ordered = [(a, b) for a in cols for b in cols]
    target = f"feature_a = '{C.TARGET}' AND feature_b <> '{C.TARGET}'"
    key = "round(r * 1e6)"
    return (_CORR_BASE + ",\n" + _corr_agg_sql(cols, pairs) + ",\n" + _corr_long_sql(cols, ordered, _cov_key(cols)) + f""",
tc AS (SELECT site, feature_b AS Feature, r,
    row_number() OVER (PARTITION BY site ORDER BY {key} DESC NULLS LAST, feature_b) AS up,
    row_number() OVER (PARTITION BY site ORDER BY {key} ASC NULLS LAST, feature_b DESC) AS down FROM corr_long WHERE {target}),
hi AS (SELECT site, feature_a, feature_b, r,
    row_number() OVER (PARTITION BY site ORDER BY round(abs(r) * 1e6) DESC, idx_a, idx_b) AS pos
  FROM corr_long WHERE idx_a < idx_b AND idx_a > 0 AND abs(r) > 0.8),
rows AS (
  SELECT site, 'correlation_matrix' AS "table", feature_a, feature_b, CAST(NULL AS INTEGER) AS position, r FROM corr_long
  UNION ALL SELECT site, 'target_correlations', Feature, NULL, up, r FROM tc
  UNION ALL SELECT site, 'top_bottom', Feature, 'top', up, r FROM tc WHERE up <= 10
  UNION ALL SELECT site, 'top_bottom', Feature, 'bottom', down, r FROM tc WHERE down <= 10
  UNION ALL SELECT site, 'high_pairs', feature_a, feature_b, pos, r FROM hi)
SELECT site, "table", feature_a, feature_b, CAST(position AS INTEGER) AS position, """ + r("r", "r") + " FROM rows")


@register("pipeline_correlation", _study_sql())
def q_pipeline_correlation(spark, sf_dir):
    """All four tables of the study, tagged and in one long form."""
    from .correlation import correlation_study
    out = correlation_study(cut_lineage(_corr_frame(spark, sf_dir).select("site", C.TARGET, *C32)), C.TARGET, C32,
                            order_key=rank_key)

    def tagged(name, a, b, position, value):
        return out[name].select("site", F.lit(name).alias("table"), a.alias("feature_a"), b.alias("feature_b"),
                                position.cast("int").alias("position"), F.col(value).alias("r"))

    null = F.lit(None).cast("string")
    return finish(
        tagged("correlation_matrix", F.col("feature_a"), F.col("feature_b"), F.lit(None), "r")
        .unionByName(tagged("target_correlations", F.col("Feature"), null, F.col("rank"), "Correlation"))
        .unionByName(tagged("top_bottom", F.col("Feature"), F.col("end"), F.col("position"), "Correlation"))
        .unionByName(tagged("high_pairs", F.col("feature_1"), F.col("feature_2"), F.col("rank"), "r")))


# --------------------------------------------------------------------------
# 2.5 windows: split, folds, samples, quantile rows
# --------------------------------------------------------------------------
@register("split_stratified", O.with_(O.panel_cte(), O.split_cte()) + " SELECT site, Date, split FROM split")
def q_split_stratified(spark, sf_dir):
    return V.split_keys(panel(spark, sf_dir))


@register("cv_group_folds", STANDIN + """
SELECT site, Date, Year, CAST(dense_rank() OVER (PARTITION BY site ORDER BY Year) - 1 AS INTEGER) AS fold
FROM standin WHERE split = 'train'""")
def q_cv_group_folds(spark, sf_dir):
    train = prepared(spark, sf_dir, S12).where(F.col("split") == "train")
    return V.cv_group_folds(train).select("site", "Date", "Year", "fold")


@register("sample_test_rows", STANDIN + SAMPLE_CTE + " SELECT site, Date FROM sample")
def q_sample_test_rows(spark, sf_dir):
    return _sample(spark, sf_dir).select("site", "Date")


_PICKS_CTE = """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY Predicted_NEE, Date) - 1 AS _pos,
         count(*) OVER (PARTITION BY site) AS _n
  FROM sample
),
slots AS (SELECT unnest([1, 2, 3, 4]) AS quantile_slot),
picks AS (
  SELECT r.*, s.quantile_slot FROM ranked r JOIN slots s
    ON r._pos = CASE s.quantile_slot WHEN 1 THEN 0 WHEN 2 THEN r._n // 3 WHEN 3 THEN (2 * r._n) // 3 ELSE r._n - 1 END
)"""


@register("pick_quantile_rows", STANDIN + SAMPLE_CTE + _PICKS_CTE
          + " SELECT site, quantile_slot, Date, " + r("Predicted_NEE", "Predicted_NEE") + " FROM picks")
def q_pick_quantile_rows(spark, sf_dir):
    picks = V.pick_quantile_rows(_sample(spark, sf_dir), "Predicted_NEE")
    return finish(picks.select("site", "quantile_slot", "Date", "Predicted_NEE"))


# --------------------------------------------------------------------------
# attribution tables (stand-in attributions)
# --------------------------------------------------------------------------
TEST_CTE = ",\ntest_rows AS (SELECT * FROM standin WHERE split = 'test')"
_TEST_LONG = STANDIN + TEST_CTE + ",\nslong AS (" + _unnest_long("test_rows", S12) + ")"
_SAMPLE_LONG = STANDIN + SAMPLE_CTE + ",\nslong AS (" + _unnest_long("sample", S12) + ")"
_SUMMARY_SQL = _TEST_LONG + """,
summary AS (
  SELECT site, Feature, avg(abs(shap)) AS Mean_Abs_SHAP, avg(shap) AS Mean_SHAP, stddev_pop(shap) AS Std_SHAP
  FROM slong GROUP BY site, Feature
),
summary_r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY round(Mean_Abs_SHAP * 1e6) DESC NULLS LAST, Feature) AS INTEGER) AS rank
  FROM summary
)"""


@register("shap_summary", _SUMMARY_SQL + " SELECT site, Feature, " + _rr(["Mean_Abs_SHAP", "Mean_SHAP", "Std_SHAP"])
          + ", rank FROM summary_r")
def q_shap_summary(spark, sf_dir):
    return finish(A.shap_summary(_test_long(spark, sf_dir), order_key=rank_key))


_FAMILY_SQL = """CASE
  WHEN starts_with(Feature, 'TA') THEN 'air_temperature'
  WHEN starts_with(Feature, 'TS') THEN 'soil_temperature'
  WHEN starts_with(Feature, 'SWC') THEN 'soil_water'
  WHEN starts_with(Feature, 'RG') THEN 'radiation'
  WHEN starts_with(Feature, 'P_lag') OR Feature = 'precipitation_rate' THEN 'precipitation'
  WHEN contains(Feature, 'Snow') OR Feature IN ('DSSM', 'D_SNOW') THEN 'snow'
  WHEN Feature IN ('VPD_f', 'RH') THEN 'humidity'
  WHEN contains(Feature, 'NDVI') THEN 'vegetation'
  WHEN contains(Feature, 'sin_doy') THEN 'season_sin'
  WHEN contains(Feature, 'cos_doy') THEN 'season_cos'
  ELSE 'other' END"""


@register("fn_feature_family", _SUMMARY_SQL + f" SELECT site, Feature, {_FAMILY_SQL} AS family, "
          + r("Mean_Abs_SHAP", "Mean_Abs_SHAP") + " FROM summary_r")
def q_fn_feature_family(spark, sf_dir):
    s = A.with_family(A.shap_summary(_test_long(spark, sf_dir)))
    return finish(s.select("site", "Feature", "family", "Mean_Abs_SHAP"))


def _top_sql(n, src="standin", name="top") -> str:
    excl = "WHERE Feature NOT IN ('sin_doy', 'cos_doy')" if n is not None else ""
    lim = f"QUALIFY rank <= {n}" if n is not None else ""
    return f""",
{name}_long AS ({_unnest_long(src, S12, value=False)}),
{name} AS (
  SELECT site, Feature, mean_abs_shap,
    CAST(row_number() OVER (PARTITION BY site ORDER BY round(mean_abs_shap * 1e6) DESC NULLS LAST, Feature) AS INTEGER) AS rank
  FROM (SELECT site, Feature, avg(abs(shap)) AS mean_abs_shap FROM {name}_long {excl} GROUP BY site, Feature)
  {lim}
)"""


@register("top_n_shap", STANDIN + _top_sql(C.TOP_N_WEEKLY) + " SELECT site, Feature, "
          + r("mean_abs_shap", "mean_abs_shap") + ", rank FROM top")
def q_top_n_shap(spark, sf_dir):
    long = A.shap_values_long(standin_frame(spark, sf_dir), S12)
    return finish(A.top_n_shap(long, C.TOP_N_WEEKLY, order_key=rank_key))


@register("shap_dependence", _TEST_LONG + _top_sql(C.TOP_N_DEPENDENCE, src="test_rows", name="top4")
          + " SELECT l.site, l.Date, l.Feature, " + r("l.value", "value") + ", " + r("l.shap", "shap")
          + ", t.rank FROM slong l JOIN top4 t USING (site, Feature)")
def q_shap_dependence(spark, sf_dir):
    long = _test_long(spark, sf_dir)
    top = A.top_n_shap(long, C.TOP_N_DEPENDENCE, order_key=rank_key)
    return finish(A.shap_dependence(long, top).select("site", "Date", "Feature", "value", "shap", "rank"))


@register("shap_value_points", _TEST_LONG + " SELECT site, Date, Feature, " + r("value", "value") + ", "
          + r("shap", "shap") + " FROM slong")
def q_shap_value_points(spark, sf_dir):
    return finish(_test_long(spark, sf_dir))


@register("shap_quantiles", _TEST_LONG + """,
placed AS (SELECT site, Feature, shap, row_number() OVER (PARTITION BY site, Feature ORDER BY shap) AS place,
                  count(*) OVER (PARTITION BY site, Feature) AS n FROM slong)
SELECT site, Feature, any_value(n) AS n, """ + r("min(shap)", "shap_min") + ", " + ", ".join(
    r(f"max(CASE WHEN place = greatest(1, ({p} * n + 99) // 100) THEN shap END)", f"q{p:02d}") for p in (5, 25, 50, 75, 95))
    + ", " + r("max(shap)", "shap_max") + " FROM placed GROUP BY site, Feature")
def q_shap_quantiles(spark, sf_dir):
    return finish(A.shap_quantiles(_test_long(spark, sf_dir)))


@register("shap_density", _TEST_LONG + """,
rng AS (SELECT site, Feature, min(shap) AS low, (max(shap) - min(shap)) / 50e0 AS w, count(shap) AS total FROM slong GROUP BY site, Feature),
binned AS (SELECT s.site, s.Feature, s.value, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((s.shap - low) / w), 49) END AS INTEGER) AS bin
  FROM slong s JOIN rng USING (site, Feature)),
filled AS (SELECT site, Feature, bin, count(*) AS n, avg(CAST(value AS DECIMAL(20, 6))) AS mean_value FROM binned GROUP BY ALL)
SELECT g.site, g.Feature, CAST(g.bin AS INTEGER) AS bin, coalesce(f.n, 0) AS n, """ + r("g.low + g.bin * g.w", "bin_lo") + ", "
          + r("g.low + (g.bin + 1) * g.w", "bin_hi") + ", " + r("coalesce(f.n, 0) / nullif(g.total * g.w, 0)", "density") + ", "
          + r("f.mean_value", "mean_value") + """
FROM (SELECT *, unnest(range(50)) AS bin FROM rng) g LEFT JOIN filled f ON f.site = g.site AND f.Feature = g.Feature AND f.bin = g.bin""")
def q_shap_density(spark, sf_dir):
    # feature values as decimals: their means tie at the last reported digit, and a double's last bit would decide
    return finish(A.shap_density(_test_long(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(20,6)"))))


@register("shap_explain_rows", _SAMPLE_LONG + _PICKS_CTE + """,
ex AS (
  SELECT l.site, l.Date, l.Feature, l.value, l.shap, p.quantile_slot, p.base_value, p.Predicted_NEE,
    CAST(row_number() OVER (PARTITION BY l.site, p.quantile_slot ORDER BY round(abs(l.shap) * 1e6) DESC, l.Feature) AS INTEGER) AS "order",
    p.base_value + sum(l.shap) OVER (PARTITION BY l.site, p.quantile_slot ORDER BY round(abs(l.shap) * 1e6) DESC, l.Feature
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total
  FROM slong l JOIN picks p USING (site, Date)
)
SELECT site, Date, Feature, quantile_slot, "order", """ + _rr(["value", "shap", "base_value", "Predicted_NEE",
                                                              "running_total"]) + " FROM ex")
def q_shap_explain_rows(spark, sf_dir):
    sample = _sample(spark, sf_dir)
    picks = V.pick_quantile_rows(sample, "Predicted_NEE")
    out = A.shap_explain_rows(A.shap_values_long(sample, S12), picks, order_key=rank_key)
    return finish(out.select("site", "Date", "Feature", "quantile_slot", "order", "value", "shap",
                             "base_value", "Predicted_NEE", "running_total"))


@register("shap_export_test", STANDIN + " SELECT site, Date, Year, Month, " + _rr([f"SHAP_{f}" for f in S12])
          + " FROM standin WHERE split = 'test'")
def q_shap_export_test(spark, sf_dir):
    return finish(A.shap_export_test(standin_frame(spark, sf_dir), S12))


@register("predictions_export", STANDIN + " " + _PRED_EXPORT_SQL_BODY)
def q_predictions_export(spark, sf_dir):
    return _pred_export(spark, sf_dir)


@register("residual_points", STANDIN + " SELECT site, split, Date, " + _rr(["Observed_NEE", "Predicted_NEE"]) + ", "
          + r("Observed_NEE - Predicted_NEE", "Residual") + ", " + r("abs(Observed_NEE - Predicted_NEE)", "Abs_Residual")
          + " FROM standin")
def q_residual_points(spark, sf_dir):
    return finish(E.residual_points(standin_frame(spark, sf_dir)))


# --------------------------------------------------------------------------
# 2.8 scalar functions
# --------------------------------------------------------------------------
@register("fn_cyclic_doy", O.with_(O.panel_cte()) + " SELECT site, Date, "
          + r("sin(2 * pi() * dayofyear(Date) / 365)", "sin_doy") + ", "
          + r("cos(2 * pi() * dayofyear(Date) / 365)", "cos_doy") + " FROM panel")
def q_fn_cyclic_doy(spark, sf_dir):
    s, c = FN.cyclic_doy()
    return finish(panel(spark, sf_dir).select("site", "Date", s, c))


@register("fn_date_parts", O.with_(O.panel_cte()) + " SELECT site, Date, CAST(year(Date) AS INTEGER) AS Year, "
          "CAST(month(Date) AS INTEGER) AS Month, CAST(dayofyear(Date) AS INTEGER) AS DOY FROM panel")
def q_fn_date_parts(spark, sf_dir):
    return panel(spark, sf_dir).select("site", "Date", *FN.date_parts())


@register("fn_residual", STANDIN + " SELECT site, Date, " + r("Observed_NEE - Predicted_NEE", "Residual") + ", "
          + r("abs(Observed_NEE - Predicted_NEE)", "Abs_Residual") + " FROM standin")
def q_fn_residual(spark, sf_dir):
    res, ares = FN.residual()
    return finish(standin_frame(spark, sf_dir).select("site", "Date", res, ares))


@register("fn_standardise", STANDIN + """,
zs AS (SELECT site, """ + ", ".join(f"avg({f}) AS _m_{f}, stddev_pop({f}) AS _s_{f}" for f in S12) + """
       FROM standin WHERE split = 'train' GROUP BY site)
SELECT site, Date, split, """ + ", ".join(r(f"({f} - _m_{f}) / coalesce(nullif(_s_{f}, 0), 1)", f) for f in S12)
          + " FROM standin JOIN zs USING (site)")
def q_fn_standardise(spark, sf_dir):
    rows = prepared(spark, sf_dir, S12)
    z = FN.standardise(rows, S12, fit_on=F.col("split") == "train")
    return finish(z.select("site", "Date", "split", *S12))


# --------------------------------------------------------------------------
# weekly calendar (stand-in attributions over all rows)
# --------------------------------------------------------------------------
_WEEKLY_CTE = """,
weekly AS (
  SELECT site, CAST(date_trunc('week', Date) AS DATE) AS week, """ + ", ".join(
    f"avg(SHAP_{f}) AS SHAP_{f}" for f in S12) + """, avg(Predicted_NEE) AS nee
  FROM standin WHERE month(CAST(date_trunc('week', Date) AS DATE)) BETWEEN 6 AND 10
  GROUP BY 1, 2
),
wlong AS (SELECT site, week, unnest([""" + ", ".join(f"'{f}'" for f in S12) + """]) AS Feature,
                 unnest([""" + ", ".join(f"SHAP_{f}" for f in S12) + """]) AS mean_shap FROM weekly),
cal AS (
  SELECT week, CAST(row_number() OVER (ORDER BY week) - 1 AS INTEGER) AS ordinal,
         CAST(year(week) AS INTEGER) AS year, CAST(month(week) AS INTEGER) AS month,
         coalesce(year(week) <> lag(year(week)) OVER (ORDER BY week), false) AS year_change
  FROM (SELECT DISTINCT week FROM weekly)
)"""


def _grid_sql(n) -> str:
    return STANDIN + _WEEKLY_CTE + _top_sql(n) + f""",
feats AS (SELECT DISTINCT Feature FROM top),
sites AS (SELECT DISTINCT site FROM standin),
grid0 AS (SELECT s.site, c.week, c.ordinal, f.Feature FROM cal c CROSS JOIN sites s CROSS JOIN feats f),
picked AS (SELECT w.* FROM wlong w JOIN top t USING (site, Feature)),
grid AS (
  SELECT g.site, g.week, g.ordinal, g.Feature, coalesce(p.mean_shap, 0e0) AS mean_shap, n.nee AS mean_nee
  FROM grid0 g LEFT JOIN picked p USING (site, week, Feature) LEFT JOIN weekly n USING (site, week)
)"""


def _weekly(spark, sf_dir):
    full = standin_frame(spark, sf_dir)
    return full, CAL.weekly_wide(full, S12)


def _grid(spark, sf_dir, n):
    from .weekly import weekly_tables
    return weekly_tables(standin_frame(spark, sf_dir), S12, top_n=n, order_key=rank_key)["grid"]


@register("weekly_shap_mean", STANDIN + _WEEKLY_CTE + " SELECT site, week, Feature, " + r("mean_shap", "mean_shap")
          + " FROM wlong")
def q_weekly_shap_mean(spark, sf_dir):
    _, wide = _weekly(spark, sf_dir)
    return finish(CAL.weekly_shap_mean(wide, S12))


@register("weekly_nee_mean", STANDIN + _WEEKLY_CTE + " SELECT site, week, " + r("nee", "mean_nee") + " FROM weekly")
def q_weekly_nee_mean(spark, sf_dir):
    _, wide = _weekly(spark, sf_dir)
    return finish(CAL.weekly_nee_mean(wide))


@register("season_calendar", STANDIN + _WEEKLY_CTE + " SELECT week, ordinal, year, month, year_change FROM cal")
def q_season_calendar(spark, sf_dir):
    _, wide = _weekly(spark, sf_dir)
    return CAL.season_calendar(wide)


@register("reindex_features", _grid_sql(C.TOP_N_DEPENDENCE) + " SELECT site, week, ordinal, Feature, "
          + r("mean_shap", "mean_shap") + ", " + r("mean_nee", "mean_nee") + " FROM grid")
def q_reindex_features(spark, sf_dir):
    return finish(_grid(spark, sf_dir, C.TOP_N_DEPENDENCE))


@register("reindex_calendar", _grid_sql(None) + " SELECT site, week, ordinal, Feature, "
          + r("mean_shap", "mean_shap") + ", " + r("mean_nee", "mean_nee") + " FROM grid")
def q_reindex_calendar(spark, sf_dir):
    return finish(_grid(spark, sf_dir, None))


_STACK_SQL = """,
stacked AS (
  SELECT *, greatest(mean_shap, 0e0) AS pos, least(mean_shap, 0e0) AS neg,
    coalesce(sum(greatest(mean_shap, 0e0)) OVER (PARTITION BY site, week ORDER BY Feature
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS pos_base,
    coalesce(sum(least(mean_shap, 0e0)) OVER (PARTITION BY site, week ORDER BY Feature
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS neg_base
  FROM grid
)"""


@register("stack_offsets", _grid_sql(C.TOP_N_WEEKLY) + _STACK_SQL + " SELECT site, week, Feature, "
          + _rr(["mean_shap", "pos", "neg", "pos_base", "neg_base"]) + " FROM stacked")
def q_stack_offsets(spark, sf_dir):
    st = CAL.stack_offsets(_grid(spark, sf_dir, C.TOP_N_WEEKLY))
    return finish(st.select("site", "week", "Feature", "mean_shap", "pos", "neg", "pos_base", "neg_base"))


_SUMS_SQL = """,
sums AS (
  SELECT site, week, sum(greatest(mean_shap, 0e0)) AS pos_sum, sum(least(mean_shap, 0e0)) AS neg_sum,
         any_value(mean_nee) AS mean_nee
  FROM grid GROUP BY site, week
)"""


@register("weekly_signed_sums", _grid_sql(C.TOP_N_WEEKLY) + _SUMS_SQL + " SELECT site, week, "
          + _rr(["pos_sum", "neg_sum", "mean_nee"]) + " FROM sums")
def q_weekly_signed_sums(spark, sf_dir):
    return finish(CAL.weekly_signed_sums(_grid(spark, sf_dir, C.TOP_N_WEEKLY)))


@register("pipeline_weekly", _grid_sql(C.TOP_N_WEEKLY) + _STACK_SQL + _SUMS_SQL + """,
bounds AS (
  SELECT site, greatest(max(pos_sum), coalesce(max(mean_nee), 0e0)) * 1.05e0 AS y_max,
         least(min(neg_sum), coalesce(min(mean_nee), 0e0), 0e0) * 1.05e0 AS y_min
  FROM sums GROUP BY site
)
SELECT s.site, s.week, s.ordinal, s.Feature, """ + ", ".join(
    r(f"s.{c}", c) for c in ("mean_shap", "pos_base", "neg_base", "mean_nee")) + ", "
          + r("b.y_min", "y_min") + ", " + r("b.y_max", "y_max") + " FROM stacked s JOIN bounds b USING (site)")
def q_pipeline_weekly(spark, sf_dir):
    from .weekly import weekly_tables
    t = weekly_tables(standin_frame(spark, sf_dir), S12, top_n=C.TOP_N_WEEKLY, order_key=rank_key)
    out = t["stacked"].join(t["bounds"], "site")
    return finish(out.select("site", "week", "ordinal", "Feature", "mean_shap", "pos_base", "neg_base",
                             "mean_nee", "y_min", "y_max"))


@register("pipeline_series", STANDIN + " SELECT site, Date, " + _rr(["Observed_NEE", "Predicted_NEE"])
          + " FROM standin WHERE Observed_NEE IS NOT NULL AND Predicted_NEE IS NOT NULL")
def q_pipeline_series(spark, sf_dir):
    from .weekly import observed_predicted_series
    return finish(observed_predicted_series(standin_frame(spark, sf_dir)))


# --------------------------------------------------------------------------
# 2.9 model operators.  Forest output is engine-specific: these queries are
# checked by invariants and brute force in tests/; their exact counterparts
# follow below.  Forests, spaces and iterations are the analysis' own
# (`PanelConfig`); all sites are grown together.
# --------------------------------------------------------------------------
RUN = C.PanelConfig()


def _forest(site: str) -> C.ForestParams:
    return RUN.of_site("forest_stage1", site)


def _matrix(spark, sf_dir, features=tuple(S12)):
    """(prepared rows, their code matrix, sites) of all sites of the data."""
    from .stages import coded, model_frame, site_names
    pan = panel(spark, sf_dir)
    sites = site_names(pan, RUN)
    feats = dict.fromkeys(sites, list(features))
    rows = model_frame(pan, V.split_keys(pan), feats)
    return rows, coded(rows, feats), sites


def _fits(sites):
    from ..operators.forests import Fit
    return [Fit(s, tuple(S12), _forest(s)) for s in sites]


def _grown(spark, sf_dir):
    from ..operators import forests as FS
    rows, matrix, sites = _matrix(spark, sf_dir)
    return rows, matrix, FS.grow_forests(matrix, _fits(sites))


def _split():
    return F.when(F.col("fold") < 0, "test").otherwise("train").alias("split")


@register("fit_forest")
def q_fit_forest(spark, sf_dir):
    forest = _grown(spark, sf_dir)[2]
    return forest.select("site", F.col("tree").cast("int").alias("treeID"), F.col("nodes").alias("n_nodes"),
                         F.col("leaves").alias("n_leaves"))


@register("predict_forest")
def q_predict_forest(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, forest = _grown(spark, sf_dir)
    return FS.predictions(matrix, forest).select("site", "Date", _split(), F.col("y").alias("Observed_NEE"), "Predicted_NEE")


@register("forest_importance")
def q_forest_importance(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, forest = _grown(spark, sf_dir)
    return FS.forest_importance(forest, matrix, S12).drop("fit")


@register("shap_tree")
def q_shap_tree(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, forest = _grown(spark, sf_dir)
    return FS.attributions(matrix, forest, S12).select("site", "Date", _split(), *[f"SHAP_{f}" for f in S12], "Predicted_NEE", "base_value")


@register("rfecv_select")
def q_rfecv_select(spark, sf_dir):
    from functools import reduce
    from ..operators import select as SEL
    from ..operators.ledger import Ledger
    _, matrix, sites = _matrix(spark, sf_dir)
    found = SEL.rfecv_forests(spark, matrix, dict.fromkeys(sites, list(S12)), {s: _forest(s) for s in sites}, Ledger(spark, RUN.ledger))
    return reduce(lambda a, b: a.unionByName(b), [r["selection"].select(F.lit(s).alias("site"), "*") for s, r in found.items()])


@register("search_random")
def q_search_random(spark, sf_dir):
    from functools import reduce
    from ..operators import search as S
    from ..operators.ledger import Ledger
    _, matrix, sites = _matrix(spark, sf_dir)
    found = S.search_forests(spark, matrix, dict.fromkeys(sites, list(S12)), {s: RUN.of_site("space", s) for s in sites}, RUN.n_iter,
                             Ledger(spark, RUN.ledger))
    return reduce(lambda a, b: a.unionByName(b), [S.top_configs(r["summary"]).select(F.lit(s).alias("site"), "*") for s, r in found.items()])


@register("oob_score")
def q_oob_score(spark, sf_dir):
    """Out-of-bag R2 of the very forests that predict."""
    from ..operators import forests as FS
    _, matrix, sites = _matrix(spark, sf_dir)
    fits = _fits(sites)
    return FS.oob_score(FS.out_of_bag(matrix, FS.grow_forests(matrix, fits), fits)).drop("fit")


@register("shap_export_full")
def q_shap_export_full(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, forest = _grown(spark, sf_dir)
    return A.shap_export_full(FS.attributions(matrix, forest, S12).withColumn("Observed_NEE", F.col("y")), S12, residuals=True)


def _long(tables: dict):
    from functools import reduce
    from .stages import tagged
    return reduce(lambda a, b: a.unionByName(b), [tagged(site, t) for site, t in tables.items()])


@register("pipeline_stage1")
def q_pipeline_stage1(spark, sf_dir):
    """Every exported table of stage 1, all sites, in one long form."""
    from . import stages
    pan = panel(spark, sf_dir)
    return _long(stages.stage1(spark, pan, V.split_keys(pan), RUN))


@register("pipeline_stage2")
def q_pipeline_stage2(spark, sf_dir):
    """Every exported table of stage 2, all sites, in one long form; compared with stage 1 on its own features."""
    from . import stages
    pan = panel(spark, sf_dir)
    keys = V.split_keys(pan)
    first, second = stages.stage1(spark, pan, keys, RUN), stages.stage2(spark, pan, keys, RUN)
    for site, tables in second.items():
        tables["stage_comparison"] = stages.stage_comparison(first[site]["metrics"], tables["metrics"], len(first[site]["selected"]),
                                                             len(S12))
    return _long(second)


# --------------------------------------------------------------------------
# model operators, exact in SQL: a depth-1 tree without bagging over features
# with fewer distinct values than bins, the elimination with a closed-form
# estimator, and the search ranking over settings of the linear predictor.
# --------------------------------------------------------------------------
STUMP = C.ForestParams(n_estimators=1, max_depth=1, max_features=1.0, max_bins=4096)
STUMP_FEATURES = ["DSSM", "NDVI_nonSR_Max", "precipitation_rate"]
_STUMP_SQL = O.with_(O.panel_cte(), O.split_cte(), O.prepared_cte(S12),
                     "prep_split AS (SELECT p.*, s.split FROM prep p JOIN split s USING (site, Date))") + f""",
vals AS (SELECT site, {C.TARGET} AS y, unnest([{", ".join(repr(f) for f in STUMP_FEATURES)}]) AS f, unnest([0, 1, 2]) AS fi,
         unnest([{", ".join(STUMP_FEATURES)}]) AS v FROM prep_split WHERE split = 'train'),
cells AS (SELECT site, f, fi, v, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM vals GROUP BY ALL),
runs AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(q) OVER w AS lq, sum(n) OVER p AS tn, sum(s) OVER p AS ts,
         sum(q) OVER p AS tq FROM cells
         WINDOW w AS (PARTITION BY site, f ORDER BY v), p AS (PARTITION BY site, f)),
best AS (SELECT *, ls / ln AS lv, (ts - ls) / (tn - ln) AS rv, ts / tn AS base FROM runs WHERE ln < tn
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, fi, v) = 1)"""
_STUMP_SIDE = "CASE WHEN " + " OR ".join(f"(f = '{f}' AND p.{f} <= v)" for f in STUMP_FEATURES) + " THEN lv ELSE rv END"


def _stumps(spark, sf_dir):
    """(rows, matrix of the stump's features, one unbagged stump of each site)."""
    from ..operators import forests as FS
    from .stages import coded, model_frame, site_names
    pan = panel(spark, sf_dir)
    sites = site_names(pan, RUN)
    rows = model_frame(pan, V.split_keys(pan), dict.fromkeys(sites, list(S12)))
    matrix = coded(rows, dict.fromkeys(sites, STUMP_FEATURES))
    return rows, matrix, FS.grow_forests(matrix, [FS.Fit(s, tuple(STUMP_FEATURES), STUMP, bootstrap=False) for s in sites])


@register("fit_forest_exact", _STUMP_SQL + " SELECT site, f AS feature, CAST(ln AS BIGINT) AS n_left, "
          "CAST(tn - ln AS BIGINT) AS n_right, " + r("lv", "left_value") + ", " + r("rv", "right_value") + " FROM best")
def q_fit_forest_exact(spark, sf_dir):
    from ..operators import forests as FS
    forest = _stumps(spark, sf_dir)[2]

    def tell(batches):
        import pandas as pd
        for pdf in batches:
            trees = [FS.tree_of(row) for row in pdf.to_dict("records")]
            yield pd.DataFrame([{"site": site, "feature": STUMP_FEATURES[t.feature[0]], "n_left": t.cover[t.left[0]],
                                 "n_right": t.cover[t.right[0]], "left_value": t.value[t.left[0]], "right_value": t.value[t.right[0]]}
                                for site, t in zip(pdf["site"], trees)])

    return finish(forest.mapInPandas(tell, "site string, feature string, n_left long, n_right long, left_value double, right_value double"))


@register("predict_forest_exact", _STUMP_SQL + f" SELECT p.site, p.Date, p.split, {r(_STUMP_SIDE, 'Predicted_NEE')} "
          "FROM prep_split p JOIN best USING (site)")
def q_predict_forest_exact(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, forest = _stumps(spark, sf_dir)
    return finish(FS.predictions(matrix, forest).select("site", "Date", _split(), "Predicted_NEE"))


@register("forest_importance_exact", _STUMP_SQL + f""",
names AS (SELECT unnest([{", ".join(repr(f) for f in STUMP_FEATURES)}]) AS Feature)
SELECT site, Feature, CASE WHEN Feature = f THEN 1e0 ELSE 0e0 END AS Importance,
  CAST(row_number() OVER (PARTITION BY site ORDER BY Feature = f DESC, Feature) AS INTEGER) AS rank FROM best, names""")
def q_forest_importance_exact(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, forest = _stumps(spark, sf_dir)
    return finish(FS.forest_importance(forest, matrix, STUMP_FEATURES).drop("fit"))


@register("shap_tree_exact", _STUMP_SQL + " SELECT p.site, p.Date, " + ", ".join(
    r(f"CASE WHEN f = '{x}' THEN {_STUMP_SIDE} - base ELSE 0e0 END", f"SHAP_{x}") for x in STUMP_FEATURES)
    + ", " + r(_STUMP_SIDE, "Predicted_NEE") + ", " + r("base", "base_value") + " FROM prep_split p JOIN best USING (site)")
def q_shap_tree_exact(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, forest = _stumps(spark, sf_dir)
    return finish(FS.attributions(matrix, forest, STUMP_FEATURES).drop("fit", "y", "fold"))


@register("shap_export_full_exact", _STUMP_SQL + f""",
scored AS (SELECT p.*, f, base, {C.TARGET} AS obs, {_STUMP_SIDE} AS pred FROM prep_split p JOIN best USING (site))
SELECT site, Date, Year, Month, """ + r("obs", "Observed_NEE") + ", " + r("pred", "Predicted_NEE") + ", "
    + r("obs - pred", "Residual") + ", " + r("abs(obs - pred)", "Abs_Residual") + ", " + ", ".join(
    r(f"CASE WHEN f = '{x}' THEN pred - base ELSE 0e0 END", f"SHAP_{x}") for x in STUMP_FEATURES) + " FROM scored")
def q_shap_export_full_exact(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, forest = _stumps(spark, sf_dir)
    scored = FS.attributions(matrix, forest, STUMP_FEATURES).withColumn("Observed_NEE", F.col("y"))
    return finish(A.shap_export_full(scored, STUMP_FEATURES))


# --------------------------------------------------------------------------
# a small forest in SQL: bags, candidate features, splits, predictions and
# out-of-bag rows of several trees, recomputed from the raw tables.
# --------------------------------------------------------------------------
SMALL_FOREST = C.ForestParams(n_estimators=3, max_depth=2, max_features=0.4, min_samples_leaf=4, min_samples_split=12, max_samples=0.8)
_GOLDEN = 0x9E3779B97F4A7C15         # the mixer's constants, as in `operators/growth.py`
_MIXERS = (30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)


def _times(x: str, k: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * CAST('{k}' AS UHUGEINT)) & CAST('18446744073709551615' AS UHUGEINT) AS UBIGINT)"


def _plus(x: str, k: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) + CAST('{k % (1 << 64)}' AS UHUGEINT)) & CAST('18446744073709551615' AS UHUGEINT) AS UBIGINT)"


def _mix_sql(name: str, source: str, columns: str, x: str) -> str:
    """CTE ``name``: the columns of the source and ``mixed``, the mixer's value of x."""
    (s1, k1), (s2, k2) = _MIXERS
    return (f"{name}_0 AS (SELECT {columns}, {x} AS h FROM {source}), "
            f"{name}_1 AS (SELECT * EXCLUDE (h), {_times(f'xor(h, h >> {s1})', k1)} AS h FROM {name}_0), "
            f"{name}_2 AS (SELECT * EXCLUDE (h), {_times(f'xor(h, h >> {s2})', k2)} AS h FROM {name}_1), "
            f"{name} AS (SELECT * EXCLUDE (h), xor(h, h >> 31) AS mixed FROM {name}_2)")


def _small_forest_sql() -> str:
    from ..operators.forest import subset_size
    from ..operators.growth import poisson_steps, tree_keys
    p = SMALL_FOREST
    keys = [int(k) for k in tree_keys(p.seed, list(range(p.n_estimators)))]
    mtry, smallest = subset_size(p.max_features, len(S12)), max(p.min_samples_split, 2 * p.min_samples_leaf)
    parts = [f"""trees AS (SELECT unnest({list(range(p.n_estimators))}) AS tree, CAST(unnest({[str(k) for k in keys]}) AS UBIGINT) AS key)""",
             f"""numbered AS (SELECT site, Date, split, {C.TARGET} AS y, [{", ".join(S12)}] AS x,
  CAST('0x' || substr(md5(site || '|' || CAST(Date AS VARCHAR)), 1, 15) AS BIGINT) AS id FROM prep_split)""",
             _mix_sql("hashed", "numbered, trees", "site, Date, split, y, x, tree, key", "xor(CAST(id AS UBIGINT), key)"),
             "drawn AS (SELECT * EXCLUDE (mixed), CAST(mixed >> 11 AS DOUBLE) * pow(2e0, -53) AS u FROM hashed)",
             "placed0 AS (SELECT site, Date, split, y, x, tree, key AS node, "
             + " + ".join(f"CASE WHEN u >= {float(c)!r}::DOUBLE THEN 1 ELSE 0 END" for c in poisson_steps(p.max_samples)) + " AS draws FROM drawn)"]
    for k in range(p.max_depth):
        parts += [
            f"bag{k} AS (SELECT * FROM placed{k} WHERE split = 'train' AND draws > 0)",
            f"open{k} AS (SELECT site, tree, node FROM bag{k} GROUP BY ALL HAVING count(*) >= {smallest} AND min(y) < max(y))",
            f"tried{k} AS (SELECT site, tree, node, unnest({list(range(len(S12)))}) AS f FROM open{k})",
            _mix_sql(f"hash{k}", f"(SELECT *, {_times('f + 1', _GOLDEN)} AS step FROM tried{k})", "site, tree, node, f",
                     "CAST((CAST(node AS UHUGEINT) + CAST(step AS UHUGEINT)) & CAST('18446744073709551615' AS UHUGEINT) AS UBIGINT)"),
            f"turn{k} AS (SELECT site, tree, node, f, (row_number() OVER (PARTITION BY site, tree, node ORDER BY mixed) - 1) // {mtry} AS turn FROM hash{k})",
            f"""cells{k} AS (SELECT b.site, b.tree, b.node, t.f, t.turn, b.x[t.f + 1] AS v, count(*) AS n, sum(draws) AS w,
  sum(draws * CAST(y AS DECIMAL(28, 12))) AS wy FROM bag{k} b JOIN turn{k} t USING (site, tree, node) GROUP BY ALL)""",
            f"""runs{k} AS (SELECT *, sum(n) OVER o AS ln, sum(w) OVER o AS lw, sum(wy) OVER o AS lwy, sum(n) OVER a AS tn, sum(w) OVER a AS tw,
  sum(wy) OVER a AS twy, lead(v) OVER o AS after FROM cells{k}
  WINDOW o AS (PARTITION BY site, tree, node, f ORDER BY v), a AS (PARTITION BY site, tree, node, f))""",
            f"""best{k} AS (SELECT site, tree, node, f, v / 2e0 + after / 2e0 AS threshold FROM runs{k}
  WHERE ln >= {p.min_samples_leaf} AND tn - ln >= {p.min_samples_leaf}
  QUALIFY row_number() OVER (PARTITION BY site, tree, node ORDER BY turn, pow(CAST(lwy AS DOUBLE), 2) / lw
    + pow(CAST(twy - lwy AS DOUBLE), 2) / (tw - lw) DESC, f, v) = 1)""",
            f"""moved{k} AS (SELECT p.*, CASE WHEN p.x[b.f + 1] <= b.threshold THEN 1 ELSE 2 END AS side
  FROM placed{k} p JOIN best{k} b USING (site, tree, node))""",
            _mix_sql(f"child{k}", f"(SELECT *, {_times('node', _GOLDEN)} AS big FROM moved{k})", "* EXCLUDE (big, side)",
                     "CAST((CAST(big AS UHUGEINT) + CAST(side AS UHUGEINT)) & CAST('18446744073709551615' AS UHUGEINT) AS UBIGINT)"),
            f"""placed{k + 1} AS (SELECT site, Date, split, y, x, tree, mixed AS node, draws FROM child{k}
  UNION ALL SELECT p.* FROM placed{k} p ANTI JOIN best{k} USING (site, tree, node))"""]
    d = p.max_depth
    parts += [f"""means AS (SELECT site, tree, node, count(*) AS n, sum(draws) AS w, CAST(sum(draws * CAST(y AS DECIMAL(28, 12))) AS DOUBLE) / sum(draws) AS mean
  FROM placed{d} WHERE split = 'train' AND draws > 0 GROUP BY ALL)""",
              f"leafed AS (SELECT p.site, p.Date, p.split, p.y, p.tree, p.draws, m.mean FROM placed{d} p JOIN means m USING (site, tree, node))",
              "splits AS (" + " UNION ALL ".join(f"SELECT {k} AS level, * FROM best{k}" for k in range(d)) + ")"]
    return _STUMP_SQL.split(",\nvals AS")[0] + ",\n" + ",\n".join(parts)


SMALL_FOREST_SQL = _small_forest_sql()
_names = "[" + ", ".join(repr(f) for f in S12) + "]"


def _small_forest(spark, sf_dir):
    from ..operators import forests as FS
    _, matrix, sites = _matrix(spark, sf_dir)
    fits = [FS.Fit(s, tuple(S12), SMALL_FOREST) for s in sites]
    return matrix, fits, FS.grow_forests(matrix, fits)


@register("forest_splits_exact", SMALL_FOREST_SQL + f" SELECT site, CAST(tree AS INTEGER) AS tree, CAST(level AS INTEGER) AS level, {_names}[f + 1] AS Feature, "
          + r("threshold", "threshold") + " FROM splits")
def q_forest_splits_exact(spark, sf_dir):
    """Every split of a bagged forest with sampled candidate features."""
    from ..operators import forests as FS
    _, _, forest = _small_forest(spark, sf_dir)

    def tell(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                t = FS.tree_of(row)
                level = np.zeros(len(t.left), int)
                for k in np.flatnonzero(t.left >= 0):
                    level[[t.left[k], t.right[k]]] = level[k] + 1
                    out.append((row["site"], row["tree"], level[k], S12[t.feature[k]], t.threshold[k]))
            yield pd.DataFrame(out, columns=["site", "tree", "level", "Feature", "threshold"])

    return finish(forest.mapInPandas(tell, "site string, tree int, level int, Feature string, threshold double"))


@register("forest_predictions_exact", SMALL_FOREST_SQL + " SELECT site, Date, split, " + r("any_value(y)", "Observed_NEE") + ", "
          + r("avg(mean)", "Predicted_NEE") + " FROM leafed GROUP BY site, Date, split")
def q_forest_predictions_exact(spark, sf_dir):
    from ..operators import forests as FS
    matrix, _, forest = _small_forest(spark, sf_dir)
    return finish(FS.predictions(matrix, forest).select("site", "Date", _split(), F.col("y").alias("Observed_NEE"), "Predicted_NEE"))


@register("oob_score_exact", SMALL_FOREST_SQL + """,
unseen AS (SELECT site, Date, any_value(y) AS y, avg(mean) AS p FROM leafed WHERE split = 'train' AND draws = 0 GROUP BY site, Date)
SELECT site, count(*) AS n_oob_rows, """ + r("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))", "oob_r2") + " FROM unseen GROUP BY site")
def q_oob_score_exact(spark, sf_dir):
    from ..operators import forests as FS
    matrix, fits, forest = _small_forest(spark, sf_dir)
    return finish(FS.oob_score(FS.out_of_bag(matrix, forest, fits)).drop("fit"))


_FOLDS_SQL = O.with_(O.panel_cte(), O.split_cte(), O.prepared_cte(S12),
                     "prep_split AS (SELECT p.*, s.split FROM prep p JOIN split s USING (site, Date))")
ELIMINATED = ["DSSM", "NDVI_nonSR_Max", "RG_min", "precipitation_rate", "SWC_10cm", "TS_10cm"]
_ELIMINATION_SQL = _FOLDS_SQL + f""",
train AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY Year) AS fold FROM prep_split WHERE split = 'train'),
vals AS (SELECT site, Date, fold, {C.TARGET} AS y, unnest([{", ".join(repr(f) for f in ELIMINATED)}]) AS f,
         unnest({list(range(len(ELIMINATED)))}) AS fi, unnest([{", ".join(ELIMINATED)}]) AS x FROM train),
held AS (SELECT DISTINCT site, fold AS k FROM train UNION ALL SELECT DISTINCT site, -1 FROM train),
fits AS (SELECT h.site, h.k, f, fi, avg(x) AS mx, avg(y) AS my, coalesce(covar_pop(x, y) / nullif(var_pop(x), 0), 0) AS slope,
         coalesce(abs(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)), 0) AS imp
  FROM vals v JOIN held h ON v.site = h.site AND v.fold <> h.k GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, k ORDER BY imp DESC, fi) AS n FROM fits),
preds AS (SELECT v.site, t.k, v.y, t.n,
          t.my + sum(t.slope * (v.x - t.mx)) OVER (PARTITION BY v.site, v.Date ORDER BY t.n) / t.n AS p
  FROM vals v JOIN ranked t ON v.site = t.site AND v.fold = t.k AND v.f = t.f),
scores AS (SELECT site, k, n, 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM preds GROUP BY ALL),
curve AS (SELECT site, n, avg(r2) AS cv, stddev_pop(r2) AS sd FROM scores GROUP BY ALL),
best AS (SELECT site, n AS n_best FROM curve QUALIFY row_number() OVER (PARTITION BY site ORDER BY cv DESC, n) = 1)"""


def _eliminate(spark, sf_dir, table):
    from functools import reduce
    from ..operators import select as SEL
    from ..operators.standin import MarginalEstimator
    rows, _, sites = _matrix(spark, sf_dir, ELIMINATED + [f for f in S12 if f not in ELIMINATED])
    outs = []
    for site in sites:
        train = rows.where((F.col("site") == site) & (F.col("fold") >= 0)).cache()
        outs.append(SEL.rfecv_select(spark, train, ELIMINATED, C.TARGET, MarginalEstimator(), parallelism=RUN.parallelism)[table]
                    .select(F.lit(site).alias("site"), "*"))
        train.unpersist()
    return reduce(lambda a, b: a.unionByName(b), outs)


@register("rfecv_select_exact", _ELIMINATION_SQL + """
SELECT site, f AS Feature, n <= n_best AS Selected, CAST(greatest(1, n - n_best + 1) AS INTEGER) AS Ranking
FROM ranked JOIN best USING (site) WHERE k = -1""")
def q_rfecv_select_exact(spark, sf_dir):
    return _eliminate(spark, sf_dir, "selection")


@register("rfecv_curve_exact", _ELIMINATION_SQL + " SELECT site, CAST(n AS INTEGER) AS N_Features, " + r("cv", "CV_R2")
          + ", " + r("sd", "CV_R2_std") + " FROM curve")
def q_rfecv_curve_exact(spark, sf_dir):
    return finish(_eliminate(spark, sf_dir, "curve"))


SETTINGS = [0.25, 0.5, 1.0, 1.5, -0.5]


@register("search_ranking_exact", STANDIN + f""",
folds AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY Year) AS fold FROM standin WHERE split = 'train'),
tried AS (SELECT s.*, unnest({list(range(len(SETTINGS)))}) AS config_id, unnest({SETTINGS}) AS c FROM folds s),
errs AS (SELECT site, config_id, fold, Observed_NEE AS y, Observed_NEE - (base_value + c * (Predicted_NEE - base_value)) AS e FROM tried),
held AS (SELECT DISTINCT site, fold AS k FROM folds),
scores AS (SELECT e.site, config_id, k,
    1 - sum(CASE WHEN fold <> k THEN e.e * e.e END) / nullif(var_pop(CASE WHEN fold <> k THEN y END) * count(CASE WHEN fold <> k THEN 1 END), 0) AS train_r2,
    1 - sum(CASE WHEN fold = k THEN e.e * e.e END) / nullif(var_pop(CASE WHEN fold = k THEN y END) * count(CASE WHEN fold = k THEN 1 END), 0) AS test_r2
  FROM errs e JOIN held h ON e.site = h.site GROUP BY ALL),
ranked AS (SELECT site, config_id, avg(test_r2) AS mean_test_score, stddev_pop(test_r2) AS std_test_score,
    avg(train_r2) AS mean_train_score, stddev_pop(train_r2) AS std_train_score FROM scores GROUP BY ALL)
SELECT site, config_id, """ + _rr(["mean_test_score", "std_test_score", "mean_train_score", "std_train_score"]) + """,
  CAST(rank() OVER (PARTITION BY site ORDER BY mean_test_score DESC NULLS LAST) AS INTEGER) AS rank_test_score FROM ranked""")
def q_search_ranking_exact(spark, sf_dir):
    """Fold scores and ranking of several settings of the linear predictor, by the search's own operators."""
    from functools import reduce
    from ..operators import search as S
    from ..operators.select import r2_by_fold
    train = V.cv_group_folds(standin_frame(spark, sf_dir).where(F.col("split") == "train"))
    train = cut_lineage(train.select("site", "fold", "base_value", C.TARGET, F.col("Predicted_NEE").alias("_p")))
    outs = []
    for site, folds in sorted((r["site"], sorted(r["folds"])) for r in train.groupBy("site").agg(
            F.collect_set("fold").alias("folds")).collect()):
        rows = train.where(F.col("site") == site)
        scores = []
        for i, c in enumerate(SETTINGS):
            pred = rows.withColumn("Predicted_NEE", F.col("base_value") + F.lit(c) * (F.col("_p") - F.col("base_value")))
            scores += [(i, int(k), *r2_by_fold(pred, C.TARGET, "fold", k)) for k in folds]
        long = spark.createDataFrame(scores, "config_id int, fold int, train_r2 double, test_r2 double")
        outs.append(S.rank_configs(long).select(F.lit(site).alias("site"), "*"))
    return finish(reduce(lambda a, b: a.unionByName(b), outs))
