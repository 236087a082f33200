"""The registered model queries run the analysis' own forests, spaces and iterations."""

import json

import pytest

from panelspark import config as C
from panelspark.operators import forests as FS
from panelspark.operators import search as S
from panelspark.operators import select as SEL
from panelspark.plans import catalog, stages
from tests.conftest import SF_SMALL

CFG = C.PanelConfig()
SITES = {"F", "O", "P"}


class Asked(Exception):
    pass


def _asked(monkeypatch, spark, module, function, name):
    """The arguments of the query's first call of an operator, which is not run."""
    def stop(*args, **options):
        raise Asked(args)

    monkeypatch.setattr(module, function, stop)
    with pytest.raises(Asked) as call:
        catalog.QUERIES[name](spark, SF_SMALL)
    return call.value.args[0]


@pytest.mark.parametrize("name", ["fit_forest", "predict_forest", "forest_importance", "shap_tree", "shap_export_full", "oob_score"])
def test_fits_use_the_analysis_forests(spark, monkeypatch, name):
    fits = _asked(monkeypatch, spark, FS, "grow_forests", name)[1]
    assert {f.site for f in fits} == SITES and all(f.params == CFG.of_site("forest_stage1", f.site) for f in fits)
    assert all(f.features == tuple(C.S12) and f.held_out is None and f.bootstrap for f in fits)


@pytest.mark.parametrize("name", ["rfecv_select", "pipeline_stage1", "pipeline_stage2"])
def test_eliminations_use_the_analysis_forests(spark, monkeypatch, name):
    _, _, features, params, _ = _asked(monkeypatch, spark, SEL, "rfecv_forests", name)
    assert params == {s: CFG.of_site("forest_stage1", s) for s in SITES}
    want = C.S12 if name == "rfecv_select" else None
    assert all(list(features[s]) == list(want or CFG.of_site("stage1_features", s)) for s in SITES)


@pytest.mark.parametrize("name", ["search_random", "pipeline_stage2"])
def test_searches_use_the_analysis_space(spark, monkeypatch, name):
    monkeypatch.setattr(stages, "stage1", lambda *args: {})
    _, _, features, spaces, n_iter, _ = _asked(monkeypatch, spark, S, "search_forests", name)
    assert spaces == {s: CFG.of_site("space", s) for s in SITES} and n_iter == 100
    assert all(list(f) == C.S12 for f in features.values())


def test_stage2_is_compared_with_stage1(spark, monkeypatch):
    """The stage-1 row has the metrics and the number of selected features of that site's stage 1."""
    def metrics(site, r2):
        return {"metrics": spark.createDataFrame([(site, m, 0.9, r2 + i) for i, m in enumerate(("R²", "RMSE", "MAE"))],
                                                 "site string, Metric string, Training double, Test double")}

    chosen = {"F": 7, "O": 3, "P": 5}
    monkeypatch.setattr(stages, "stage1", lambda *args: {
        s: metrics(s, 0.25) | {"selected": list(CFG.of_site("stage1_features", s))[:n]} for s, n in chosen.items()})
    monkeypatch.setattr(stages, "stage2", lambda *args: {s: metrics(s, 0.5) for s in chosen})
    rows = [(r["site"], json.loads(r["row"])) for r in
            catalog.QUERIES["pipeline_stage2"](spark, SF_SMALL).where("table = 'stage_comparison'").collect()]
    got = {(s, r["Stage"]): (r["Test_R2"], r["Test_RMSE"], r["Test_MAE"], r["N_Features"]) for s, r in rows}
    assert got == {(s, stage): row for s, n in chosen.items() for stage, row in
                   (("Stage 1 (RFE)", (0.25, 1.25, 2.25, n)), ("Stage 2 (HPT)", (0.5, 1.5, 2.5, len(C.S12))))}
