"""Eliminations that make several steps inside a task, and the rows that scores read."""

import datetime

import numpy as np
import pytest

from panelspark.config import ForestParams
from panelspark.operators import forests as FS
from panelspark.operators import growth as G
from panelspark.operators import ledger as LE
from panelspark.operators import select as SEL
from panelspark.operators.codes import DICTIONARY, SiteRows, code_matrix
from panelspark.session import scratch_path

NAMES = ["a", "b", "c", "flat"]
PARAMS = ForestParams(n_estimators=5, max_depth=5, max_features=0.5, min_samples_leaf=2, max_samples=0.8)


@pytest.fixture(scope="module")
def small(spark):
    rng, rows = np.random.default_rng(5), []
    for site in ("X", "Y"):
        for i in range(150):
            a, b, c = (float(v) for v in rng.integers(0, 40, 3))
            rows.append((site, datetime.date(2001, 1, 1) + datetime.timedelta(i), i % 4 - 1, 2 * a - b + float(rng.normal()), a, b, c, 1.0))
    return code_matrix(spark.createDataFrame(rows, "site string, Date date, fold int, y double, a double, b double, c double, flat double"),
                       NAMES, "y")


def _tables(found):
    rows_of = lambda t: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()), key=str)
    return {(site, name): rows_of(r[name]) for site, r in found.items() for name in ("scores", "selection", "curve")}


def test_elimination_without_a_job_for_each_step(spark, small, monkeypatch):
    """Several steps of an elimination in a task give the tables of one job a step."""
    features, params = {"X": NAMES, "Y": NAMES[:3]}, {"X": PARAMS, "Y": PARAMS.with_(n_estimators=3)}
    stepwise = _tables(SEL.rfecv_forests(spark, small, features, params, LE.Ledger(spark, scratch_path(spark, "t-steps"))))

    def never(*args):
        raise AssertionError("a job for one step")

    jobs, real = [], LE.score_ahead
    monkeypatch.setattr(LE, "score_fits", never)
    monkeypatch.setattr(LE, "score_ahead", lambda *args: jobs.append(args) or real(*args))
    book = LE.Ledger(spark)
    assert _tables(SEL.rfecv_forests(spark, small, features, params, book)) == stepwise and len(jobs) == 1
    # every fit once: all folds with each number of features, and the whole training part down to two
    assert book.table().count() == book.table().select("key").distinct().count() == 3 * 4 + 3 * 3 + 3 + 2
    monkeypatch.setattr(FS, "AHEAD_ROWS", 2 * 150 * 5)                          # two steps a task
    assert _tables(SEL.rfecv_forests(spark, small, features, params, LE.Ledger(spark))) == stepwise and len(jobs) == 1 + 2


def test_large_sites_and_named_ledgers_go_step_by_step(spark, small, monkeypatch):
    fits, steps, real = [FS.Fit("X", tuple(NAMES), PARAMS, 0)], [], LE.score_fits
    monkeypatch.setattr(LE, "score_fits", lambda m, f: steps.append(len(f)) or real(m, f))
    LE.Ledger(spark, scratch_path(spark, "t-named")).scores(small, fits, following=SEL._next_fit)
    monkeypatch.setattr(FS, "AHEAD_ROWS", 150 * 5)                              # one fit fills a task
    LE.Ledger(spark).scores(small, fits, following=SEL._next_fit)
    monkeypatch.setattr(LE, "LOCAL_ROWS", 10)
    LE.Ledger(spark).scores(small, fits, following=SEL._next_fit)
    assert steps == [1, 1, 1]


def test_scores_read_no_test_rows(monkeypatch):
    """Predictions of a unit are made for the rows that a score reads, and for those they are right."""
    rng = np.random.default_rng(3)
    codes, fold = rng.integers(0, 50, (4, 300)).astype(np.uint16), rng.integers(-1, 3, 300).astype(np.int32)
    y = codes[0] - 0.5 * codes[1] + rng.normal(size=300)
    site = SiteRows(np.arange(300) * 7919, np.arange(300, dtype=np.int32), y, fold, codes, [(0, 300)], [np.arange(50.0)] * 4,
                    G.Scale.of(y.mean(), np.abs(y - y.mean()).max(), 300), 300)
    spec = FS.Fit("X", tuple(NAMES), PARAMS, 1).spec(NAMES)
    trees, seen, real = FS.unit_trees(spec, site, 0, 5), [], FS.predict_codes
    monkeypatch.setattr(FS, "predict_codes", lambda t, c: seen.append(c.shape[1]) or real(t, c))
    parts = FS._part_rows({"fit": 0, "first": 0}, spec, site, trees, 4).to_pylist()
    pred = np.frombuffer(next(p for p in parts if p["block"] != DICTIONARY)["sums"])

    def walk(tree, x, node=0):
        while tree.left[node] >= 0:
            node = tree.left[node] if x[tree.feature[node]] <= tree.code[node] else tree.right[node]
        return tree.value[node]

    assert set(seen) == {int((fold >= 0).sum())}
    for i in np.flatnonzero(fold >= 0):
        assert abs(pred[i] - sum(walk(t, codes[:, i]) for t in trees)) < 1e-9
    for tree in trees:                                    # codes and thresholds name the same split
        inner = tree.left >= 0
        assert (tree.code[inner] == np.floor(tree.threshold[inner])).all()
