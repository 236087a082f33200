"""Forest, attribution and selection invariants (engine-specific outputs)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import config as C
from panelspark.config import ForestParams
from panelspark.operators import forest as FO
from panelspark.operators import search as S
from panelspark.operators import select as SEL
from panelspark.operators import treeshap as TS
from panelspark.operators import validate as V
from panelspark.plans.frames import prepared
from tests.conftest import SF_CHECK
from tests.shapley import brute_force_shap

FEATS = list(C.S12)


@pytest.fixture(scope="module")
def rows(spark):
    return prepared(spark, SF_CHECK, FEATS).where("site = 'F'").cache()


@pytest.fixture(scope="module")
def model(rows):
    return FO.fit_forest(rows.where("split = 'train'"), FEATS, C.TARGET,
                         ForestParams(n_estimators=8, max_depth=5, max_features=0.5, min_samples_leaf=2))


def test_param_mapping():
    p = FO.mllib_params(ForestParams(max_depth=None, max_features="log2"), 32)
    assert p["maxDepth"] == 30 and p["featureSubsetStrategy"] == "5"
    assert FO.subset_size("sqrt", 34) == 5 and FO.subset_size(0.3, 12) == 3 and FO.subset_size(0.01, 12) == 1
    assert FO.mllib_params(ForestParams(max_depth=50), 5)["maxDepth"] == 30


def test_importance_sums_to_one(spark, model):
    imp = FO.forest_importance(spark, model, FEATS).agg(F.sum("Importance")).collect()[0][0]
    assert abs(imp - 1.0) < 1e-9


def test_shap_additivity_and_prediction(spark, rows, model):
    trees = FO.tree_arrays(spark, model)
    sh = TS.shap_tree(rows, trees, FEATS, keep=("site", "Date"))
    pred = FO.predict_forest(model, rows, FEATS).select("site", "Date", F.col("Predicted_NEE").alias("mllib"))
    j = sh.join(pred, ["site", "Date"])
    total = sum(F.col(f"SHAP_{f}") for f in FEATS) + F.col("base_value")
    r = j.agg(F.max(F.abs(total - F.col("Predicted_NEE"))).alias("add"),
              F.max(F.abs(F.col("Predicted_NEE") - F.col("mllib"))).alias("pred"), F.count("*").alias("n")).collect()[0]
    assert r["n"] == rows.count()
    assert r["add"] < 1e-9 and r["pred"] < 1e-9


def test_shap_equals_brute_force(spark, rows):
    small = FO.fit_forest(rows, FEATS[:4], C.TARGET,
                          ForestParams(n_estimators=3, max_depth=3, max_features=1.0, min_samples_leaf=3))
    trees = FO.tree_arrays(spark, small)
    x = rows.select(*FEATS[:4]).limit(6).toPandas().to_numpy(dtype=float)
    phi, _ = TS.shap_matrix(x, TS.build_paths(trees), 4)
    for k in range(len(x)):
        assert np.allclose(phi[k], brute_force_shap(x[k], trees), atol=1e-10)


def test_unused_feature_gets_zero(spark, rows):
    m = FO.fit_forest(rows, FEATS[:3], C.TARGET,
                      ForestParams(n_estimators=2, max_depth=2, max_features=1.0, min_samples_leaf=5))
    trees = FO.tree_arrays(spark, m)
    used = {int(f) for t in trees for f in t.feature if f >= 0}
    x = rows.select(*FEATS[:3]).limit(20).toPandas().to_numpy(dtype=float)
    phi, _ = TS.shap_matrix(x, TS.build_paths(trees), 3)
    for j in range(3):
        if j not in used:
            assert np.all(phi[:, j] == 0)


def test_chunked_shap_equals_single_pass(spark, rows, model):
    trees = FO.tree_arrays(spark, model)
    one = TS.shap_tree(rows, trees, FEATS, keep=("Date",)).orderBy("Date").toPandas()
    many = TS.shap_tree(rows, trees, FEATS, keep=("Date",), leaves=40).orderBy("Date").toPandas()
    cols = [f"SHAP_{f}" for f in FEATS] + ["Predicted_NEE", "base_value"]
    assert np.allclose(one[cols].to_numpy(), many[cols].to_numpy(), atol=1e-10)


def test_least_important_tie_takes_later():
    assert SEL.least_important(["a", "b", "c"], [0.2, 0.1, 0.1]) == "c"
    assert SEL.least_important(["a", "b", "c"], [0.05, 0.1, 0.1]) == "a"


def test_rfecv_ranking(spark, rows):
    train = V.cv_group_folds(rows.where("split = 'train'")).cache()
    feats = FEATS[:5]
    res = SEL.rfecv_select(spark, train, feats, C.TARGET,
                           ForestParams(n_estimators=3, max_depth=3, max_features=1.0, min_samples_leaf=5))
    sel = {r["Feature"]: (r["Selected"], r["Ranking"]) for r in res["selection"].collect()}
    n = res["n_features"]
    assert sum(1 for s, _ in sel.values() if s) == n
    assert sorted(r for s, r in sel.values() if not s) == list(range(2, len(feats) - n + 2))
    assert all(r == 1 for s, r in sel.values() if s)
    assert res["curve"].count() == len(feats)


def test_search_configs_in_space(spark):
    cfg = S.search_configs(spark, C.SPACE_FIRST, 50).collect()
    assert len(cfg) == 50
    for r in cfg:
        assert 100 <= r["n_estimators"] < 500 and 2 <= r["min_samples_split"] < 20
        assert 1 <= r["min_samples_leaf"] < 10 and 0.6 <= r["max_samples"] <= 1.0
        assert r["max_depth"] in ("10", "20", "30", "40", "50", None)
        assert r["max_features"] in ("sqrt", "log2", "0.3", "0.5", "0.7")
    again = S.search_configs(spark, C.SPACE_FIRST, 50).collect()
    assert cfg == again


def test_rank_configs_ties_share_min_rank(spark):
    long = spark.createDataFrame([(0, 0, 0.9, 0.5), (1, 0, 0.9, 0.5), (2, 0, 0.9, 0.7)],
                                 "config_id int, fold int, train_r2 double, test_r2 double")
    ranks = {r["config_id"]: r["rank_test_score"] for r in S.rank_configs(long).collect()}
    assert ranks == {2: 1, 0: 2, 1: 2}


def test_oob_rows_and_score(spark, rows):
    train = rows.where("split = 'train'")
    bag = S.fit_bagged_forest(spark, train, FEATS, C.TARGET,
                              ForestParams(n_estimators=6, max_depth=4, max_features=0.5, max_samples=0.8))
    oob = S.oob_predictions(train, bag, FEATS)
    covered = oob.where(F.col("oob_trees") > 0).count()
    assert covered > 0.9 * train.count()
    one = sorted(tuple(r) for r in oob.collect())
    many = sorted(tuple(r) for r in S.oob_predictions(train, bag, FEATS, per_pass=1).collect())
    assert len(one) == len(many)
    for a, b in zip(one, many):
        assert a[:2] == b[:2] and a[3] == b[3]
        assert (a[2] is None and b[2] is None) or abs(a[2] - b[2]) < 1e-9
    score = S.oob_score(train, bag, FEATS, C.TARGET).collect()[0]
    assert score["oob_r2"] is not None and score["oob_r2"] < 1.0


def test_split_count_prunes_nodes(spark, rows):
    """Two settings that differ in the split count only give different trees; SHAP holds on the pruned one."""
    base = ForestParams(n_estimators=3, max_depth=6, max_features=1.0, min_samples_leaf=1)
    feats = FEATS[:4]
    full = FO.tree_arrays(spark, FO.fit_forest(rows, feats, C.TARGET, base))
    cut = FO.fit_forest(rows, feats, C.TARGET, base.with_(min_samples_split=60))
    assert isinstance(cut, FO.PrunedForest)
    for a, b in zip(full, cut.trees):
        live = b.reachable()
        assert live.sum() < a.reachable().sum()
        assert (b.cover[live & (b.left >= 0)] >= 60).all()
    assert abs(sum(cut.importances()) - 1) < 1e-9
    sample = rows.limit(40)
    x = sample.select(*feats).toPandas().to_numpy(dtype=float)
    phi, pred = TS.shap_matrix(x, TS.build_paths(cut.trees), 4)
    base_value = TS.expected_value(TS.build_paths(cut.trees))
    assert np.allclose(phi.sum(1) + base_value, pred)
    assert np.allclose(pred, np.mean([t.predict(x) for t in cut.trees], axis=0))
    assert all(np.allclose(phi[k], brute_force_shap(x[k], cut.trees), atol=1e-10) for k in range(5))
    scored = FO.predict_forest(cut, sample, feats)
    assert scored.columns == [*sample.columns, "Predicted_NEE"]
    assert np.allclose(sorted(r["Predicted_NEE"] for r in scored.collect()), sorted(pred))


def test_parameter_table(spark):
    table = {r["Parameter"]: r["Value"] for r in S.params_table(spark, ForestParams(max_depth=50), {"max_depth_used": 17}).collect()}
    assert table["max_depth"] == "50" and table["max_depth_used"] == "17"
    assert {r["Parameter"]: r["Value"] for r in S.params_table(spark, ForestParams()).collect()}["max_depth"] is None
