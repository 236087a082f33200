"""Recursive feature elimination with leave-one-year-out cross-validation.

Per fold (one held-out training year), a forest is fitted on the current
feature set, scored (R2) on the held-out year, and the least important
feature is removed, from all p features down to one.  The mean score per
feature count picks n (fewest features on ties); elimination is then
repeated on the whole training set down to n features, which gives the
selected set and the elimination ranking.

Every fit and score is a distributed Spark job over the cached training
rows; folds run concurrently from a small driver thread pool.  Only model
metadata (importances, one score per fit) reaches the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ForestParams
from .forest import fit_forest, importances, predict_forest
from .forests import Fit


def r2_score(pred: DataFrame, label: str, predicted: str = "Predicted_NEE") -> float | None:
    """R2 of one scored frame (one aggregate job; NULL for constant labels)."""
    e = F.col(label) - F.col(predicted)
    row = pred.agg((F.lit(1.0) - F.sum(e * e) / F.nullif(F.var_pop(label) * F.count(e), F.lit(0.0)))
                   .alias("r2")).collect()[0]
    return row["r2"]


def r2_by_fold(pred: DataFrame, label: str, fold_col: str, k, predicted: str = "Predicted_NEE"):
    """(R2 on rows outside fold k, R2 on fold k) of one scored frame, in one aggregate job."""
    e = F.col(label) - F.col(predicted)
    out = []
    for cond in (F.col(fold_col) != k, F.col(fold_col) == k):
        y, ee = F.when(cond, F.col(label)), F.when(cond, e)
        out.append((F.lit(1.0) - F.sum(ee * ee) / F.nullif(F.var_pop(y) * F.count(ee), F.lit(0.0))))
    row = pred.agg(out[0].alias("a"), out[1].alias("b")).collect()[0]
    return row["a"], row["b"]


def least_important(features, importances) -> str:
    """Lowest importance; on a tie the later-listed feature."""
    best = None
    for i, (f, v) in enumerate(zip(features, importances)):
        if best is None or v <= best[1]:
            best = (f, v, i)
    return best[0]


class ForestEstimator:
    """Forest fits as the elimination's estimator: fit, predict and importances over DataFrames."""

    def __init__(self, params: ForestParams):
        self.params = params

    def fit(self, train: DataFrame, features, label: str):
        return fit_forest(train, features, label, self.params)

    def predict(self, model, df: DataFrame, features) -> DataFrame:
        return predict_forest(model, df, features)

    def importances(self, model) -> list[float]:
        return importances(model)


def eliminate(train: DataFrame, features, label: str, estimator, n_keep: int = 1,
              test: DataFrame | None = None):
    """Backward elimination from all features to ``n_keep``.

    Returns (scores per feature count when ``test`` is given, elimination order).
    """
    current = list(features)
    scores, order = {}, []
    while True:
        model = estimator.fit(train, current, label)
        if test is not None:
            scores[len(current)] = r2_score(estimator.predict(model, test, current), label)
        if len(current) <= n_keep:
            break
        drop = least_important(current, estimator.importances(model))
        order.append(drop)
        current = [f for f in current if f != drop]
    return scores, order, current


def rfecv_select(spark: SparkSession, train: DataFrame, features, label: str, estimator,
                 fold_col: str = "fold", parallelism: int = 4) -> dict:
    """Run the cross-validated elimination; returns curve, selection and ranking tables.

    ``estimator`` is forest parameters or an object like ``ForestEstimator``.
    """
    if isinstance(estimator, ForestParams):
        estimator = ForestEstimator(estimator)
    features = list(features)
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())
    if len(folds) < 2:
        raise ValueError("Need at least 2 unique years for year folds.")

    def run_fold(k):
        tr = train.where(F.col(fold_col) != k)
        te = train.where(F.col(fold_col) == k)
        scores, _, _ = eliminate(tr, features, label, estimator, 1, te)
        return k, scores

    # The whole-train elimination does not depend on the chosen n until the
    # cut: its order is the same whether it stops at n or runs on to one
    # feature (same data, features and seed give the same fits), so it runs
    # alongside the folds and is cut afterwards.
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        full = pool.submit(eliminate, train, features, label, estimator, 1, None)
        fold_scores = list(pool.map(run_fold, folds))
        _, full_order, _ = full.result()

    return selection_tables(spark, features, dict(fold_scores), full_order)


def selection_tables(spark: SparkSession, features, fold_scores: dict, full_order: list) -> dict:
    """Curve, selection and ranking from the scores by fold and feature count and the elimination order on all rows."""
    rows = [(int(k), int(n), None if s is None else float(s)) for k, sc in fold_scores.items() for n, s in sc.items()]
    long = spark.createDataFrame(rows, "fold int, N_Features int, r2 double")
    curve = long.groupBy("N_Features").agg(F.avg("r2").alias("CV_R2"), F.stddev_pop("r2").alias("CV_R2_std"))
    curve_rows = {r["N_Features"]: r["CV_R2"] for r in curve.collect()}
    best_score = max(v for v in curve_rows.values() if v is not None)
    n_best = min(n for n, v in curve_rows.items() if v == best_score)

    p = len(features)
    order = full_order[:p - n_best]
    selected = [f for f in features if f not in set(order)]
    ranking = {f: 1 for f in selected}
    for i, f in enumerate(order):
        ranking[f] = p - n_best + 1 - i
    sel = spark.createDataFrame([(f, f in selected, int(ranking[f])) for f in features],
                                "Feature string, Selected boolean, Ranking int")
    return {"curve": curve, "scores": long, "selection": sel, "n_features": n_best,
            "cv_best": best_score, "selected": [f for f in features if f in selected]}


def _next_fit(fit: Fit, importance: dict[str, float]) -> Fit | None:
    """The fit after the least important feature has gone, as far as the elimination goes on."""
    drop = least_important(fit.features, [importance.get(f, 0.0) for f in fit.features])
    left = tuple(f for f in fit.features if f != drop)
    return replace(fit, features=left) if len(left) > (fit.held_out is None) else None


def rfecv_forests(spark: SparkSession, matrix, features: dict[str, list], params: dict[str, ForestParams], ledger) -> dict[str, dict]:
    """``rfecv_select`` with forests for all sites at once: steps of the elimination are jobs over all (site, fold) fits.

    A (site, fold) task makes several steps where its site's rows are few; else a step is one job.
    The driver holds one score and one importance per feature and fit.
    """
    chains = {}
    for site in features:
        if len(matrix.folds[site]) < 2:
            raise ValueError("Need at least 2 unique years for year folds.")
        chains |= {(site, k): list(features[site]) for k in (*matrix.folds[site], None)}
    scores: dict = {chain: {} for chain in chains}
    order: dict = {chain: [] for chain in chains}
    while True:
        live = [c for c, names in chains.items() if len(names) > (c[1] is None)]
        if not live:
            break
        found = ledger.scores(matrix, [Fit(site, tuple(chains[site, k]), params[site], k) for site, k in live], following=_next_fit)
        for (site, k), score in zip(live, found):
            names = chains[site, k]
            scores[site, k][len(names)] = score.test_r2
            drop = least_important(names, [score.importances.get(f, 0.0) for f in names])
            order[site, k].append(drop)
            chains[site, k] = [f for f in names if f != drop]
    return {site: selection_tables(spark, list(features[site]), {k: scores[site, k] for k in matrix.folds[site]}, order[site, None])
            for site in features}
