"""End-to-end runs on the user's own site tables: stage 1, stage 2 with its comparison, weekly, correlation."""

import pytest

from panelspark import config as C
from panelspark.config import ForestParams
from panelspark.plans import run as R
from panelspark.plans.frames import panel
from panelspark.session import scratch_path
from tests.conftest import SF_SMALL

FEATS = tuple(C.S12[:5])
SPACE = {"n_estimators": ("randint", 2, 4), "max_depth": ("choice", [2, 3]), "min_samples_split": ("randint", 2, 30),
         "min_samples_leaf": ("randint", 1, 3), "max_features": ("choice", ["sqrt", 0.5]), "max_samples": ("uniform", 0.6, 0.4)}
CFG = C.PanelConfig(target="flux", stage1_features={None: FEATS}, stage2_features=FEATS, correlation_features=FEATS,
                    forest_stage1={None: ForestParams(n_estimators=3, max_depth=3, max_features=1.0, min_samples_leaf=3)},
                    space={None: SPACE}, n_iter=2)


@pytest.fixture(scope="module")
def folder(spark):
    """Two CSV files with site names, target and column order of their own."""
    base = scratch_path(spark, "t-sites")
    cols = [c for c in FEATS if c not in C.SEASONAL]
    for site, name in (("F", "north"), ("P", "south_2")):
        df = panel(spark, SF_SMALL).where(f"site = '{site}'").selectExpr(f"{C.TARGET} as flux", *cols, "Date")
        tmp = f"{base}-{name}"
        df.coalesce(1).write.option("header", True).csv(tmp)
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(tmp).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(tmp)) if "part-" in s.getPath().getName())
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(base))
        assert fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{base}/{name}_complete.csv"))
    return base


def test_all_stages_on_own_tables(spark, folder):
    out = scratch_path(spark, "t-run")
    pan = R.load_panel(spark, CFG, input_dir=folder)
    sites = R.site_names(pan, CFG)
    assert sites == ["north", "south_2"]
    chosen = R.run_stage1(spark, CFG, pan, out, "parquet")
    assert set(chosen) == set(sites)
    R.run_stage2(spark, CFG, pan, out, "parquet")
    for site in sites:
        base = f"{out}/{site}"
        for stage, tables in (("stage1", ("rfecv_performance_curve", "rf_default_parameters", "shap_values", "test_predictions",
                                          "residual_histogram", "full_dataset_predictions_shap_values")),
                              ("stage2", ("best_hyperparameters", "hyperparameter_search_top20", "shap_values", "oob",
                                          "test_predictions", "full_dataset_predictions_shap_values"))):
            for t in tables:
                assert spark.read.parquet(f"{base}/{stage}/{t}").count() > 0, (stage, t)
        m = {r["Metric"]: r for r in spark.read.parquet(f"{base}/stage1/metrics").collect()}
        assert set(m) == {"R²", "RMSE", "MAE"} and m["R²"]["N_Features"] == float(len(chosen[site]))
        both = spark.read.parquet(f"{base}/stage2/stage_comparison").collect()
        assert {r["Stage"] for r in both} == {"Stage 1 (RFE)", "Stage 2 (HPT)"}
        assert all(r["Test_RMSE"] > 0 for r in both)
        full = spark.read.parquet(f"{base}/stage2/full_dataset_predictions_shap_values")
        assert set(f"SHAP_{f}" for f in FEATS) <= set(full.columns)
        assert full.count() == spark.read.parquet(f"{base}/stage1/full_dataset_predictions_shap_values").count()
    R.run_weekly(spark, CFG, sites, out, "parquet")
    bounds = spark.read.parquet(f"{out}/weekly/top{CFG.top_n}/bounds").collect()
    assert {r["site"] for r in bounds} == set(sites) and all(r["y_min"] <= 0 <= r["y_max"] for r in bounds)
    R.run_correlation(spark, CFG, pan, out, "parquet")
    assert spark.read.parquet(f"{out}/correlation/correlation_matrix").count() == 2 * 36


def test_comparison_is_empty_without_stage_one(spark, folder):
    out = scratch_path(spark, "t-run")
    cfg = CFG.with_(sites=("north",), oob=False, n_iter=1)
    pan = R.load_panel(spark, cfg, input_dir=folder)
    assert R.run_stage2(spark, cfg, pan, out, "parquet") == ["north"]
    assert spark.read.parquet(f"{out}/north/stage2/stage_comparison").count() == 0


def test_partitioned_site_tables(spark):
    from panelspark.sources.files import scan_site_tables, write_site_csvs
    base = scratch_path(spark, "t-sites")
    pan = panel(spark, SF_SMALL)
    write_site_csvs(pan, base, "fieldseason")
    back = scan_site_tables(spark, base, "fieldseason")
    assert back.count() == pan.count() and back.select("site").distinct().count() == 3


def test_unlisted_sites_use_the_default_entry():
    cfg = C.PanelConfig()
    assert cfg.of_site("stage1_features", "F") != cfg.of_site("stage1_features", "elsewhere")
    assert cfg.of_site("space", "elsewhere") == C.SPACE_SECOND
