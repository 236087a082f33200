"""Forests of many fits at once: growth against a brute-force grower, scores, attributions, out-of-bag rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import config as C
from panelspark.config import ForestParams
from panelspark.operators import codes as CO
from panelspark.operators import forest_levels as FL
from panelspark.operators import forests as FS
from panelspark.operators import growth as G
from panelspark.operators import linear_shap as LS
from panelspark.operators import search as S
from panelspark.operators import select as SEL
from panelspark.operators import validate as V
from panelspark.operators.ledger import Ledger
from panelspark.plans.frames import prepared
from panelspark.session import scratch_path
from tests.conftest import SF_CHECK
from tests.shapley import brute_force_shap

FEATS = list(C.S12)
SMALL = ForestParams(n_estimators=4, max_depth=6, max_features=0.4, min_samples_leaf=2, min_samples_split=7, max_samples=0.8)


def _grown_by_hand(x, q, w, key, features, mtry, limit, min_leaf, min_split, scale, depth=0):
    """The split rule, one node and one threshold at a time."""
    rows = np.flatnonzero(w)
    node = {"rows": len(rows), "value": scale.centre + scale.unit * ((w[rows] * q[rows]).sum() / w[rows].sum())}
    if len(rows) < max(min_split, 2 * min_leaf) or len(set(q[rows])) < 2 or (limit is not None and depth >= limit):
        return node
    order, best = G.candidate_order(np.array([key], np.uint64), np.array(sorted(features)))[0], None
    for at in range(0, len(order), mtry):
        for f in order[at:at + mtry]:
            values = np.unique(x[f, rows])
            for a, b in zip(values, values[1:]):
                left, right = rows[x[f, rows] <= a], rows[x[f, rows] > a]
                if min(len(left), len(right)) >= min_leaf:
                    score = sum(float((w[s] * q[s]).sum()) ** 2 / w[s].sum() for s in (left, right))
                    best = min(best or (np.inf,), (-score, f, a, b))
        if best:
            break
    if best is None:
        return node
    _, f, a, b = best
    keys = G.child_keys(np.array([key], np.uint64))
    args = (features, mtry, limit, min_leaf, min_split, scale, depth + 1)
    return node | {"feature": int(f), "threshold": a / 2 + b / 2, "left": _grown_by_hand(x, q, w * (x[f] <= a), keys[0][0], *args),
                   "right": _grown_by_hand(x, q, w * (x[f] > a), keys[1][0], *args)}


def _assert_same(tree, node, want):
    assert tree.rows[node] == want["rows"] and abs(tree.value[node] - want["value"]) < 1e-9
    if "feature" not in want:
        assert tree.left[node] < 0
        return
    assert tree.feature[node] == want["feature"] and abs(tree.threshold[node] - want["threshold"]) < 1e-12
    _assert_same(tree, tree.left[node], want["left"])
    _assert_same(tree, tree.right[node], want["right"])


def _data(n, p, kinds, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, kinds, (p, n)).astype(float) * 0.37
    y = 2 * x[0] + np.sin(x[1]) + rng.normal(0, 1, n)
    values = [np.unique(v) for v in x]
    codes = np.array([np.searchsorted(v, c) for v, c in zip(values, x)], np.uint16)
    return x, y, values, codes, rng.integers(1 << 62, size=n)


@pytest.mark.parametrize("n,kinds,lam,params,features", [
    (30, 3, 1.0, (2, None, 1, 2), range(5)), (80, 40, 0.7, (3, 4, 2, 5), (1, 3, 4)), (120, 5, 1.0, (1, None, 3, 7), range(5)),
    (120, 60, 1.0, (5, None, 1, 2), range(5)), (60, 2, 0.6, (1, 9, 1, 2), range(5))])
def test_growth_equals_brute_force(n, kinds, lam, params, features):
    x, y, values, codes, ids = _data(n, 5, kinds)
    scale = G.Scale.of(y.mean(), abs(y - y.mean()).max(), n)
    q, keys = scale.encode(y), G.tree_keys(42, np.arange(4))
    bags = G.bag_counts(ids, keys, lam)
    trees = G.grow(codes, values, q, bags, keys, features, *params, scale)
    for tree, bag, key in zip(trees, bags, keys):
        _assert_same(tree, 0, _grown_by_hand(x, q, bag, key, list(features), *params, scale))


def test_unlimited_trees_end_in_pure_or_smallest_leaves():
    x, y, values, codes, ids = _data(400, 6, 300)
    scale = G.Scale.of(y.mean(), abs(y - y.mean()).max(), 400)
    keys = G.tree_keys(1, np.arange(3))
    for tree in G.grow(codes, values, scale.encode(y), G.bag_counts(ids, keys, 1.0), keys, range(6), 2, None, 1, 2, scale):
        assert (tree.rows[tree.left < 0] == 1).all() and tree.cover[0] == tree.cover[tree.left < 0].sum()
    for tree in G.grow(codes, values, scale.encode(y), G.bag_counts(ids, keys, 1.0), keys, range(6), 2, 45, 1, 2, scale):
        assert tree.depth() <= 45


def test_bag_counts_are_poisson():
    counts = G.bag_counts(np.arange(200_000), G.tree_keys(3, np.arange(2)), 0.8)
    share = np.bincount(counts.ravel()) / counts.size
    assert abs(counts.mean() - 0.8) < 0.01 and abs(share[0] - np.exp(-0.8)) < 0.005 and abs(share[2] - 0.32 * np.exp(-0.8)) < 0.005


def _old_form(tree):
    from panelspark.operators.forest import TreeArrays
    return TreeArrays(tree.feature, tree.threshold, tree.left, tree.right, tree.value, tree.cover.astype(float), tree.gain)


def test_linear_attribution_equals_paths_and_brute_force():
    from panelspark.operators import treeshap as TS
    x, y, values, codes, ids = _data(300, 6, 40)
    scale = G.Scale.of(y.mean(), abs(y - y.mean()).max(), 300)
    keys = G.tree_keys(1, np.arange(5))
    trees = G.grow(codes, values, scale.encode(y), G.bag_counts(ids, keys, 1.0), keys, range(6), 3, None, 1, 2, scale)
    phi, pred, base = LS.shap_codes(trees, codes[:, :50])
    want, want_pred = TS.shap_matrix(x[:, :50].T, TS.build_paths([_old_form(t) for t in trees]), 6)
    assert np.allclose(phi / 5, want.T, atol=1e-9) and np.allclose(pred / 5, want_pred, atol=1e-9)
    assert np.allclose(phi.sum(0) + base, pred, atol=1e-9)
    small = G.grow(codes, values, scale.encode(y), G.bag_counts(ids, keys, 1.0), keys, range(6), 6, 3, 3, 2, scale)
    phi, _, _ = LS.shap_codes(small, codes[:, :6])
    for k in range(6):
        assert np.allclose(phi[:, k] / 5, brute_force_shap(x[:, k], [_old_form(t) for t in small]), atol=1e-10)
    stump = G.grow(codes, values, scale.encode(y), G.bag_counts(ids, keys, 1.0), keys, range(6), 6, 0, 3, 2, scale)
    phi, pred, base = LS.shap_codes(stump, codes)
    assert not phi.any() and np.allclose(pred, base)


@pytest.fixture(scope="module")
def rows(spark):
    df = prepared(spark, SF_CHECK, FEATS).where("site in ('F', 'P')")
    train = V.cv_group_folds(df.where("split = 'train'"))
    return df.join(train.select("site", "Date", "fold"), ["site", "Date"], "left").fillna(CO.TEST_FOLD, ["fold"]).cache()


@pytest.fixture(scope="module")
def matrix(rows):
    return CO.code_matrix(rows, FEATS, C.TARGET)


def _site(rows, site):
    return rows.where(F.col("site") == site).orderBy("Date").toPandas()


def _by_tree(forest):
    return {(r["fit"], r["tree"]): FS.tree_of(r.asDict()) for r in forest.collect()}


def _canonical(tree):
    """Nodes by path, so that the order of nodes does not matter."""
    order = np.argsort(tree.key)
    return [np.asarray(getattr(tree, a))[order].tolist() for a in ("key", "feature", "code", "threshold", "value", "cover", "rows", "gain")]


def test_forest_table_equals_brute_force(rows, matrix):
    fits = [FS.Fit("F", tuple(FEATS), SMALL, 2), FS.Fit("P", tuple(FEATS[3:9]), SMALL.with_(max_features=1.0), None)]
    trees = _by_tree(FS.grow_forests(matrix, fits))
    assert set(trees) == {(f, t) for f in (0, 1) for t in range(4)}
    for number, fit in enumerate(fits):
        pdf = _site(rows, fit.site)
        stats = pdf[C.TARGET]
        centre = rows.where(F.col("site") == fit.site).agg(F.avg(C.TARGET)).first()[0]
        scale = G.Scale.of(centre, max(stats.max() - centre, centre - stats.min()), len(pdf))
        train = FS.in_training(pdf["fold"].to_numpy(), fit.held_out)
        ids = np.array([r[0] for r in rows.where(F.col("site") == fit.site).orderBy("Date").select(CO.row_id()).collect()])
        x, q = pdf[FEATS].to_numpy(float).T[:, train], scale.encode(stats.to_numpy()[train])
        spec = fit.spec(FEATS)
        for t, key in enumerate(G.tree_keys(C.SEED, np.arange(2))):
            bag = G.bag_counts(ids[train], np.array([key]), spec["lam"])[0]
            _assert_same(trees[number, t], 0, _grown_by_hand(x, q, bag, key, spec["features"], spec["mtry"], 6, 2, 7, scale))


def test_levels_grow_the_same_trees(matrix, monkeypatch):
    """Level by level over blocks, with subtrees finished in tasks: the same nodes as grown in one task."""
    fits = [FS.Fit("P", tuple(FEATS), SMALL, 1), FS.Fit("F", ("DSSM", "NDVI_nonSR_Max", "RG_min"), SMALL.with_(max_features=0.4), None),
            FS.Fit("F", tuple(FEATS[:6]), SMALL.with_(max_depth=2, n_estimators=2), FS.ALL_ROWS)]
    want = {k: _canonical(t) for k, t in _by_tree(FS.grow_forests(matrix, fits)).items()}
    few = matrix.sizes["F"] // 5
    monkeypatch.setattr(FS, "LOCAL_ROWS", few)
    got = {k: _canonical(t) for k, t in _by_tree(FS.grow_forests(matrix, fits)).items()}
    assert got == want
    scores = {r["fit"]: r for r in FS.score_fits(matrix, fits[:2]).collect()}
    monkeypatch.undo()
    for r in FS.score_fits(matrix, fits[:2]).collect():
        other = scores[r["fit"]]
        assert abs(r["train_r2"] - other["train_r2"]) < 1e-9
        assert (r["test_r2"] is None and other["test_r2"] is None) or abs(r["test_r2"] - other["test_r2"]) < 1e-9
        assert np.allclose([i["v"] for i in r["importances"]], [i["v"] for i in other["importances"]])


def test_blocks_do_not_change_the_forest(rows, matrix, monkeypatch):
    fits = [FS.Fit("F", tuple(FEATS), SMALL, None)]
    want = {k: _canonical(t) for k, t in _by_tree(FS.grow_forests(matrix, fits)).items()}
    monkeypatch.setattr(CO, "BLOCK_ROWS", 300)
    monkeypatch.setattr(FS, "TREE_ROWS", 3000)
    cut = CO.code_matrix(rows, FEATS, C.TARGET)
    assert cut.blocks.where("site = 'F' and block >= 0").count() > 3
    forest = FS.grow_forests(cut, fits)
    assert {k: _canonical(t) for k, t in _by_tree(forest).items()} == want
    monkeypatch.setattr(FS, "CHUNK_NODES", 40)
    many = {r["Date"]: r for r in FS.attributions(cut, forest, FEATS).collect()}
    monkeypatch.undo()
    one = {r["Date"]: r for r in FS.attributions(matrix, FS.grow_forests(matrix, fits), FEATS).collect()}
    cols = [c for c in one[next(iter(one))].asDict() if c not in ("site", "Date", "fit")]
    assert set(one) == set(many) and all(np.allclose([one[d][c] for c in cols], [many[d][c] for c in cols]) for d in one)


def test_predictions_scores_and_importances(rows, matrix):
    fits = [FS.Fit("F", tuple(FEATS), SMALL, 3), FS.Fit("P", tuple(FEATS), SMALL, None)]
    forest = FS.grow_forests(matrix, fits)
    pred = FS.predictions(matrix, forest).toPandas()
    for number, fit in enumerate(fits):
        pdf = _site(rows, fit.site).set_index("Date")
        x = pdf[FEATS].to_numpy(float)
        trees = [t for (f, _), t in sorted(_by_tree(forest).items()) if f == number]
        want = np.mean([_old_form(t).predict(x) for t in trees], axis=0)
        mine = pred[pred["fit"] == number].set_index("Date").loc[pdf.index]
        assert np.allclose(mine["Predicted_NEE"], want) and np.allclose(mine["y"], pdf[C.TARGET])
        score = next(r for r in FS.score_fits(matrix, fits).collect() if r["fit"] == number)
        fold, y = pdf["fold"].to_numpy(), pdf[C.TARGET].to_numpy(float)
        r2 = lambda m: 1 - ((y[m] - want[m]) ** 2).sum() / ((y[m] - y[m].mean()) ** 2).sum()
        assert abs(score["train_r2"] - r2(FS.in_training(fold, fit.held_out))) < 1e-9
        assert (score["test_r2"] is None) if fit.held_out is None else abs(score["test_r2"] - r2(fold == 3)) < 1e-9
        mean = np.mean([t.importances(len(FEATS)) for t in trees], axis=0)
        assert np.allclose([i["v"] for i in score["importances"]], mean)
        table = FS.forest_importance(forest, matrix, FEATS).where(F.col("fit") == number).orderBy("rank").collect()
        assert abs(sum(r["Importance"] for r in table) - 1) < 1e-9 and [r["rank"] for r in table] == list(range(1, 13))
        assert np.allclose(sorted(r["Importance"] for r in table), sorted(mean))


def test_attributions_add_up(matrix):
    forest = FS.grow_forests(matrix, [FS.Fit("F", tuple(FEATS), SMALL.with_(max_depth=None), None)])
    total = sum(F.col(f"SHAP_{f}") for f in FEATS) + F.col("base_value")
    out = FS.attributions(matrix, forest, FEATS)
    assert out.agg(F.max(F.abs(total - F.col("Predicted_NEE")))).first()[0] < 1e-9
    assert out.count() == matrix.sizes["F"]


def test_out_of_bag_rows_are_those_of_the_fit(spark, rows, matrix):
    """The forest that predicts is the one that is scored: rows without a draw, by the bags of the growth."""
    fits = [FS.Fit("F", tuple(FEATS), SMALL, None)]
    forest = FS.grow_forests(matrix, fits)
    oob = FS.out_of_bag(matrix, forest, fits)
    pdf = _site(rows, "F")
    ids = np.array([r[0] for r in rows.where("site = 'F'").orderBy("Date").select(CO.row_id()).collect()])
    trees = [t for _, t in sorted(_by_tree(forest).items())]
    unseen = G.bag_counts(ids, G.tree_keys(C.SEED, np.arange(4)), 0.8) == 0
    for bag, tree in zip(~unseen[:, pdf["fold"].to_numpy() >= 0], trees):
        assert bag.sum() == tree.rows[0]
    x = pdf[FEATS].to_numpy(float)
    values = np.where(unseen, [_old_form(t).predict(x) for t in trees], 0).sum(0)
    want = {d: (v / n if n else None, n) for d, v, n, k in zip(pdf["Date"], values, unseen.sum(0), pdf["fold"]) if k >= 0}
    got = {r["Date"]: (r["oob_prediction"], r["oob_trees"]) for r in oob.collect()}
    assert set(got) == set(want)
    for d, (v, n) in want.items():
        assert got[d][1] == n and (got[d][0] is None if v is None else abs(got[d][0] - v) < 1e-9)
    score = FS.oob_score(oob).first()
    rows_ = [(y, want[d][0]) for d, y in zip(pdf["Date"], pdf[C.TARGET]) if d in want and want[d][0] is not None]
    y, p = map(np.array, zip(*rows_))
    assert score["n_oob_rows"] == len(y) and abs(score["oob_r2"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_quantised_dictionary(rows, monkeypatch):
    """A feature with more distinct values than codes is cut at quantiles, the others stay exact."""
    monkeypatch.setattr(CO, "MOST_CODES", 64)
    cut = CO.code_matrix(rows.where("site = 'F'"), ["DSSM", "RG_min"], C.TARGET)
    head = cut.blocks.where("block = -1").first()
    sizes = np.frombuffer(head["ids"], np.int64)
    exact = rows.where("site = 'F'").select("DSSM").distinct().count()
    assert sizes[0] == min(exact, 64) and 32 <= sizes[1] <= 64
    assert {(r["fit"], r["tree"]) for r in FS.grow_forests(cut, [FS.Fit("F", ("DSSM", "RG_min"), SMALL, None)]).collect()} == {
        (0, t) for t in range(4)}


def test_no_rows_or_trees_on_the_driver(spark, matrix, monkeypatch):
    """Trees meet blocks in joins: nothing is collected, broadcast or turned into pandas, whatever the forest's size."""
    from pyspark import SparkContext
    fits = [FS.Fit("F", tuple(FEATS), SMALL, None)]
    forest = FS.grow_forests(matrix, fits)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def refused(*args, **options):
        raise AssertionError("rows or trees on the driver")

    for kind, names in ((type(forest), ("collect", "toPandas", "toArrow", "toLocalIterator", "first", "take")), (SparkContext, ("broadcast",))):
        for name in names:
            monkeypatch.setattr(kind, name, refused)
    try:
        frames = [FS.predictions(matrix, forest), FS.attributions(matrix, forest, FEATS), FS.out_of_bag(matrix, forest, fits),
                  FS.importances(forest, matrix)]
        for df in frames:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "Broadcast" not in plan
            df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_specs_follow_the_parameters():
    spec = FS.Fit("F", ("b", "a"), ForestParams(max_depth=50, max_features="log2", max_samples=0.7), 3).spec(["a", "b", "c"])
    assert json.loads(json.dumps(spec)) == spec
    assert spec["features"] == [0, 1] and spec["depth"] == 50 and spec["mtry"] == 1 and spec["lam"] == 0.7 and spec["held_out"] == 3
    assert FL.TOP.keys() >= FS.ARRAYS.keys()


@pytest.fixture(scope="module")
def plans(matrix):
    feats = {"F": FEATS[:5], "P": FEATS[3:7]}
    return feats, {s: SMALL.with_(max_features=1.0, min_samples_leaf=5) for s in feats}


def test_elimination_of_all_sites_together(spark, matrix, plans):
    """Same scores, order and selection as one elimination after the other."""
    feats, params = plans
    found = SEL.rfecv_forests(spark, matrix, feats, params, Ledger(spark))
    for site, names in feats.items():
        for fold in (matrix.folds[site][0], None):
            current, order = list(names), []
            while len(current) > 1:
                score = Ledger(spark).scores(matrix, [FS.Fit(site, tuple(current), params[site], fold)])[0]
                order.append(SEL.least_important(current, [score.importances[f] for f in current]))
                if fold is not None:
                    got = found[site]["scores"].where((F.col("fold") == fold) & (F.col("N_Features") == len(current))).first()["r2"]
                    assert got == score.test_r2
                current = [f for f in current if f != order[-1]]
            if fold is None:
                n = found[site]["n_features"]
                ranking = {r["Feature"]: r["Ranking"] for r in found[site]["selection"].collect()}
                dropped = order[:len(names) - n]
                assert set(found[site]["selected"]) == set(names) - set(dropped)
                assert [ranking[f] for f in dropped] == list(range(len(names) - n + 1, 1, -1))
        assert found[site]["curve"].count() == len(names)


def test_search_of_all_sites_together(spark, matrix):
    space = C.SPACE_SECOND | {"n_estimators": ("randint", 2, 5)}
    found = S.search_forests(spark, matrix, dict.fromkeys(("F", "P"), FEATS), {"F": space, "P": space}, 3, Ledger(spark, wave=5))
    for site, res in found.items():
        assert res["scores"].count() == 3 * len(matrix.folds[site])
        best = res["summary"].orderBy("rank_test_score", "config_id").first()
        assert res["best"]["config_id"] == best["config_id"] and res["best_params"].n_estimators == best["n_estimators"]
        one = res["scores"].orderBy("config_id", "fold").first()
        row = next(r for r in S.search_configs(spark, space, 3).collect() if r["config_id"] == one["config_id"])
        again = Ledger(spark).scores(matrix, [FS.Fit(site, tuple(FEATS), S._as_params(row.asDict()), one["fold"])])[0]
        assert (again.train_r2, again.test_r2) == (one["train_r2"], one["test_r2"])


def test_a_killed_run_repeats_no_finished_fit(spark, matrix, plans, monkeypatch):
    """The elimination dies half-way; the next one reads the ledger and fits only what is open."""
    from panelspark.operators import ledger as LE
    feats, params = plans
    path, fitted, real = scratch_path(spark, "t-ledger"), [], LE.score_fits

    def counted(matrix, fits, limit=None):
        if limit is not None and len(fitted) >= limit:
            raise RuntimeError("killed")
        fitted.extend(fits)
        return real(matrix, fits)

    monkeypatch.setattr(LE, "score_fits", lambda m, f: counted(m, f, 20))
    with pytest.raises(RuntimeError):
        SEL.rfecv_forests(spark, matrix, feats, params, Ledger(spark, path, wave=7))
    first = list(fitted)
    assert Ledger(spark, path).table().count() == len(first) > 0       # results can be read before the run has ended
    monkeypatch.setattr(LE, "score_fits", lambda m, f: counted(m, f))
    resumed = SEL.rfecv_forests(spark, matrix, feats, params, Ledger(spark, path))
    assert len(set(fitted)) == len(fitted)
    whole = SEL.rfecv_forests(spark, matrix, feats, params, Ledger(spark))
    for site in feats:
        rows_of = lambda t: sorted(map(tuple, t.collect()))
        assert rows_of(resumed[site]["scores"]) == rows_of(whole[site]["scores"])
    before = len(fitted)
    SEL.rfecv_forests(spark, matrix, feats, params, Ledger(spark, path))
    assert len(fitted) == before


def test_ledger_tells_data_and_parameters_apart(spark, rows, matrix):
    other = CO.code_matrix(rows.where("Year < 2000"), FEATS, C.TARGET)
    fit, book = FS.Fit("F", tuple(FEATS), SMALL, 1), Ledger(spark)
    keys = [book.key(matrix, fit), book.key(other, fit), book.key(matrix, FS.Fit("F", tuple(FEATS), SMALL, 2)),
            book.key(matrix, FS.Fit("F", tuple(FEATS[1:]), SMALL, 1)), book.key(matrix, FS.Fit("F", tuple(FEATS), SMALL.with_(seed=1), 1))]
    assert len(set(keys)) == 5 and book.key(CO.code_matrix(rows, FEATS, C.TARGET), fit) == keys[0]
