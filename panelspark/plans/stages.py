"""Stage 1 (feature elimination) and stage 2 (hyper-parameter search) pipelines.

Both stages share the year-stratified split (computed once from the panel)
and produce the same family of tables: metrics overall and per year, the
exported metrics layout, impurity and SHAP importances, test SHAP values,
test predictions, parameters and the full-data predictions with SHAP.

All sites go through a stage together: their rows are one code matrix, and
every step of the elimination or wave of the search is one job over all (site,
fold, setting) fits. Table work is lazy DataFrame algebra.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import ForestParams, PanelConfig
from ..operators import attribution as A
from ..operators import evaluate as E
from ..operators import forests as FS
from ..operators import search as S
from ..operators import select as SEL
from ..operators import validate as V
from ..operators.codes import TEST_FOLD, CodeMatrix, code_matrix
from ..operators.ledger import Ledger
from ..operators.prepare import prepare, scan_by_site_period
from ..session import cut_lineage


def site_names(panel: DataFrame, cfg: PanelConfig) -> list[str]:
    """The run's sites: those configured, else all of the panel (one small row per site)."""
    return list(cfg.sites) if cfg.sites is not None else sorted(
        r["site"] for r in panel.select("site").distinct().collect())


def model_frame(panel: DataFrame, keys: DataFrame, features: dict[str, list], period: str = "",
                target: str = C.TARGET) -> DataFrame:
    """Prepared, split rows of all sites with their year folds, checkpointed.

    ``features`` lists each site's own features; rows are complete in those. A feature that only
    other sites use is 0 where it is missing (no fit of the site reads it).
    """
    every = list(dict.fromkeys(f for names in features.values() for f in names))
    lists: dict[tuple, list] = {}
    for site, names in features.items():
        lists.setdefault(tuple(names), []).append(site)
    parts = []
    for names, sites in lists.items():
        rows = V.split_stratified(prepare(scan_by_site_period(panel, sites=sites, period=period), list(names), target), keys)
        filled = [F.coalesce(F.col(f), F.lit(0.0)).alias(f) if f not in names else F.col(f) for f in every]
        parts.append(rows.select("site", "Date", "Year", "Month", "split", *filled, target))
    rows = cut_lineage(reduce(DataFrame.unionByName, parts))
    folds = V.cv_group_folds(rows.where(F.col("split") == "train")).select("site", "Date", "fold")
    return cut_lineage(rows.join(folds, ["site", "Date"], "left").fillna(TEST_FOLD, ["fold"]))


def coded(rows: DataFrame, features: dict[str, list], target: str = C.TARGET) -> CodeMatrix:
    return code_matrix(rows, list(dict.fromkeys(f for names in features.values() for f in names)), target)


def _evaluate(spark, pred: DataFrame, features, model_label: str, extra_metrics: dict) -> dict:
    overall = E.metrics_overall(pred)
    return {
        "metrics_overall": overall,
        "metrics": E.metrics_table(overall, extra_metrics),
        "metrics_by_year": E.metrics_by_year(pred, "test"),
        "residual_profile": E.residual_profile(pred),
        "residual_histogram": E.residual_histogram(pred),
        "residual_points": E.residual_points(pred),
        "test_predictions": E.predictions_export(pred, features),
    }


def _attribution(test: DataFrame, features, sample: int | None) -> dict:
    """SHAP tables of the attributed test rows (of a seeded sample of ``sample`` rows a site, if set)."""
    rows = test if sample is None else V.sample_test_rows(test, sample)
    long = A.shap_values_long(rows, features)
    return {
        "shap_feature_importance": A.shap_summary(long),
        "shap_values": A.shap_export_test(test, features),
        "shap_dependence": A.shap_dependence(long, A.top_n_shap(long, C.TOP_N_DEPENDENCE)),
        "shap_value_points": long,
        "shap_quantiles": A.shap_quantiles(long),
        "shap_density": A.shap_density(long),
        "shap_explain_rows": A.shap_explain_rows(A.shap_values_long(test, features), V.pick_quantile_rows(test, "Predicted_NEE")),
    }


def of_fit(table: DataFrame, number: int) -> DataFrame:
    return table.where(F.col("fit") == number).drop("fit", "y", "fold")


def stage1(spark: SparkSession, panel: DataFrame, keys: DataFrame, cfg: PanelConfig = PanelConfig(),
           refit_on_full: bool = True) -> dict[str, dict]:
    """Feature elimination for every site, then evaluation and attribution of the selected models: tables by site.

    Metrics come from plain predictions; attributions are computed for the
    test rows, and for all rows only for the full export.
    """
    target, sites = cfg.target, site_names(panel, cfg)
    feats = {s: list(cfg.of_site("stage1_features", s)) for s in sites}
    params: dict[str, ForestParams] = {s: cfg.of_site("forest_stage1", s) for s in sites}
    rows = model_frame(panel, keys, feats, cfg.period, target)
    matrix = coded(rows, feats, target)
    chosen = SEL.rfecv_forests(spark, matrix, feats, params, Ledger(spark, cfg.ledger))
    fits = [FS.Fit(s, tuple(chosen[s]["selected"]), params[s]) for s in sites]
    full = [FS.Fit(s, f.features, params[s], FS.ALL_ROWS) for s, f in zip(sites, fits)] if refit_on_full else []
    forest = FS.grow_forests(matrix, fits + full)
    known = rows.drop("fold").withColumn("Observed_NEE", F.col(target))
    predicted = cut_lineage(FS.predictions(matrix, forest.where(F.col("fit") < len(fits))))
    shap = cut_lineage(FS.attributions(matrix, forest, matrix.features, test_only=range(len(fits)) if full else ()))
    depth = {r["fit"]: r["d"] for r in forest.groupBy("fit").agg(F.max("depth").alias("d")).collect()}
    importance = cut_lineage(FS.forest_importance(forest, matrix, matrix.features))
    out = {}
    for i, site in enumerate(sites):
        mine, names, sel = known.where(F.col("site") == site), list(fits[i].features), chosen[site]
        pred = mine.join(of_fit(predicted, i), ["site", "Date"])
        test = mine.where(F.col("split") == "test").join(of_fit(shap, i), ["site", "Date"])
        all_rows = mine.join(of_fit(shap, i + len(fits) if full else i), ["site", "Date"])
        tables = _evaluate(spark, pred, names, "Default RF",
                           {"CV_Best": F.lit(sel["cv_best"]), "N_Features": F.lit(float(len(names)))})
        tables.update(_attribution(test, names, cfg.shap_sample))
        tables.update({
            "feature_selection_results": sel["selection"].orderBy("Ranking", "Feature"),
            "rfecv_performance_curve": sel["curve"].orderBy("N_Features"),
            "feature_importance": of_fit(importance, i).where(F.col("Feature").isin(names)).drop("site"),
            "rf_default_parameters": S.params_table(spark, params[site], {"max_depth_used": depth[i]}),
            "selected": names,
            "full_dataset_predictions_shap_values": A.shap_export_full(all_rows, names, residuals=False),
        })
        out[site] = tables
    return out


def stage2(spark: SparkSession, panel: DataFrame, keys: DataFrame, cfg: PanelConfig = PanelConfig()) -> dict[str, dict]:
    """Random search for every site, then evaluation and attribution of the best models: tables by site.

    The out-of-bag score is that of the reported forest: its bags are hashes, so the rows
    without a draw in a tree are known.
    """
    target, sites, names = cfg.target, site_names(panel, cfg), list(cfg.stage2_features)
    feats = dict.fromkeys(sites, names)
    rows = model_frame(panel, keys, feats, cfg.period, target)
    matrix = coded(rows, feats, target)
    found = S.search_forests(spark, matrix, feats, {s: cfg.of_site("space", s) for s in sites}, cfg.n_iter, Ledger(spark, cfg.ledger))
    fits = [FS.Fit(s, tuple(names), found[s]["best_params"]) for s in sites]
    forest = FS.grow_forests(matrix, fits)
    shap = cut_lineage(FS.attributions(matrix, forest, names))
    known = rows.drop("fold").withColumn("Observed_NEE", F.col(target))
    scored_all = cut_lineage(known.join(shap.drop("y", "fold"), ["site", "Date"]))
    depth = {r["fit"]: r["d"] for r in forest.groupBy("fit").agg(F.max("depth").alias("d")).collect()}
    importance = cut_lineage(FS.forest_importance(forest, matrix, names))
    oob = cut_lineage(FS.oob_score(FS.out_of_bag(matrix, forest, fits))) if cfg.oob else None
    out = {}
    for i, site in enumerate(sites):
        scored, res = scored_all.where(F.col("fit") == i).drop("fit"), found[site]
        extra = {"CV_Best": F.lit(res["cv_best"])}
        if oob is not None:
            extra["OOB"] = F.lit(oob.where(F.col("fit") == i).collect()[0]["oob_r2"])
        tables = _evaluate(spark, scored, names, "Tuned RF", extra)
        tables.update(_attribution(scored.where(F.col("split") == "test"), names, cfg.shap_sample))
        tables.update({
            "best_hyperparameters": S.params_table(spark, res["best_params"], {"max_depth_used": depth[i]}),
            "hyperparameter_search_top20": S.top_configs(res["summary"], 20),
            "search_scores": res["scores"],
            "feature_importance": of_fit(importance, i).drop("site"),
            "full_dataset_predictions_shap_values": A.shap_export_full(scored, names, residuals=True),
            "scored": scored,
        })
        if oob is not None:
            tables["oob"] = oob.where(F.col("fit") == i).select("n_oob_rows", "oob_r2")
        out[site] = tables
    return out


def tagged(site: str, tables: dict) -> DataFrame:
    """Every table of a run in one long form: (site, table, row as JSON)."""
    frames = [df.select(F.lit(site).alias("site"), F.lit(name).alias("table"),
                        F.to_json(F.struct("*")).alias("row"))
              for name, df in tables.items() if isinstance(df, DataFrame) and name != "scored"]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def stage_comparison(stage1_metrics: DataFrame, stage2_metrics: DataFrame, n1: int | None, n2: int) -> DataFrame:
    """Test R2/RMSE/MAE of both stages per site (stage-1 table may be empty: then no rows)."""
    def pick(m, stage, model, n):
        return m.groupBy("site").agg(
            F.max(F.when(F.col("Metric") == "R²", F.col("Test"))).alias("Test_R2"),
            F.max(F.when(F.col("Metric") == "RMSE", F.col("Test"))).alias("Test_RMSE"),
            F.max(F.when(F.col("Metric") == "MAE", F.col("Test"))).alias("Test_MAE"),
        ).select("site", F.lit(stage).alias("Stage"), "Test_R2", "Test_RMSE", "Test_MAE",
                 F.lit(model).alias("Model"), F.lit(n).cast("int").alias("N_Features"))
    s1 = pick(stage1_metrics, "Stage 1 (RFE)", "Default RF", n1)
    s2 = pick(stage2_metrics, "Stage 2 (HPT)", "Tuned RF", n2)
    both = s1.join(s2.select("site"), "site", "left_semi")
    return both.unionByName(s2.join(s1.select("site"), "site", "left_semi"))

