"""Randomised hyper-parameter search with year folds, and out-of-bag scoring.

Configurations are drawn as a small DataFrame (seeded ``rand``); every
(config, fold) fit is a distributed MLlib job submitted from a bounded
driver thread pool; train and held-out R2 of each fit form a long score
table that is aggregated, ranked and joined back to the configurations in
Spark.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import ForestParams
from .forest import fit_forest, predict_forest, tree_arrays
from .forests import Fit
from .select import r2_by_fold

PARAM_COLS = ["n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_features", "max_samples"]


def _draw(spec, u):
    kind = spec[0]
    if kind == "randint":
        lo, hi = spec[1], spec[2]
        return F.floor(F.lit(lo) + u * F.lit(hi - lo)).cast("int")
    if kind == "uniform":
        loc, scale = spec[1], spec[2]
        return F.lit(float(loc)) + u * F.lit(float(scale))
    if kind == "choice":
        opts = [F.lit(None if o is None else str(o)) for o in spec[1]]
        idx = F.floor(u * F.lit(len(spec[1]))).cast("int") + 1
        return F.element_at(F.array(*opts), idx)
    raise ValueError(spec)


def search_configs(spark: SparkSession, space: dict, n_iter: int, seed: int = C.SEED) -> DataFrame:
    """n_iter configurations (config_id, params...) drawn from the space, reproducibly.

    ``randint`` excludes its upper bound; ``uniform(loc, scale)`` spans
    [loc, loc + scale]; choices are strings (``None`` = unlimited depth).
    """
    base = spark.range(n_iter).withColumnRenamed("id", "config_id").coalesce(1)
    cols = [F.col("config_id").cast("int").alias("config_id")]
    for i, name in enumerate(PARAM_COLS):
        cols.append(_draw(space[name], F.rand(seed + i)).alias(name))
    return base.select(*cols)


def _as_params(row: dict) -> ForestParams:
    def num(v):
        if v is None or v == "None":
            return None
        f = float(v)
        return int(f) if f.is_integer() and "." not in str(v) else f

    mf = row["max_features"]
    mf = mf if mf in ("sqrt", "log2") else float(mf)
    return ForestParams(n_estimators=int(row["n_estimators"]), max_depth=num(row["max_depth"]),
                        max_features=mf, min_samples_leaf=int(row["min_samples_leaf"]),
                        min_samples_split=int(row["min_samples_split"]), max_samples=float(row["max_samples"]))


def search_random(spark: SparkSession, train: DataFrame, features, label: str, space: dict,
                  n_iter: int, fold_col: str = "fold", parallelism: int = 4, seed: int = C.SEED) -> dict:
    """Fit every config on every fold; rank by mean held-out R2; refit the best on all train rows."""
    features = list(features)
    configs = search_configs(spark, space, n_iter, seed)
    cfg_rows = [r.asDict() for r in configs.collect()]          # n_iter small rows of parameters
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())
    if len(folds) < 2:
        raise ValueError("Need at least 2 unique years for year folds.")

    def run(task):
        cfg, k = task
        params = _as_params(cfg)
        tr = train.where(F.col(fold_col) != k)
        model = fit_forest(tr, features, label, params)
        r2_train, r2_test = r2_by_fold(predict_forest(model, train, features), label, fold_col, k)
        return (cfg["config_id"], int(k), r2_train, r2_test)

    tasks = [(c, k) for c in cfg_rows for k in folds]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scores = list(pool.map(run, tasks))
    long = spark.createDataFrame(scores, "config_id int, fold int, train_r2 double, test_r2 double")
    summary = rank_configs(long).join(configs, "config_id")
    best = summary.orderBy("rank_test_score", "config_id").limit(1).collect()[0].asDict()
    best_params = _as_params(best)
    model = fit_forest(train, features, label, best_params)
    return {"scores": long, "summary": summary, "best": best, "best_params": best_params, "model": model,
            "cv_best": best["mean_test_score"]}


def search_forests(spark: SparkSession, matrix, features: dict[str, list], spaces: dict[str, dict], n_iter: int, ledger,
                   seed: int = C.SEED) -> dict[str, dict]:
    """``search_random`` for all sites at once: (site, config, fold) fits are scored in waves of the ledger.

    The largest fits come first, so the last tasks of a wave are short ones.
    """
    drawn, work = {}, []
    for site, space in spaces.items():
        if len(matrix.folds[site]) < 2:
            raise ValueError("Need at least 2 unique years for year folds.")
        configs = search_configs(spark, space, n_iter, seed)
        drawn[site] = (configs, [r.asDict() for r in configs.collect()])        # n_iter small rows of parameters
        work += [(site, row, k) for row in drawn[site][1] for k in matrix.folds[site]]
    fits = [Fit(site, tuple(features[site]), _as_params(row), k) for site, row, k in work]
    found, out = ledger.scores(matrix, fits, with_importances=False), {}
    for site, (configs, _) in drawn.items():
        rows = [(row["config_id"], int(k), s.train_r2, s.test_r2) for (name, row, k), s in zip(work, found) if name == site]
        long = spark.createDataFrame(rows, "config_id int, fold int, train_r2 double, test_r2 double")
        summary = rank_configs(long).join(configs, "config_id")
        best = summary.orderBy("rank_test_score", "config_id").limit(1).collect()[0].asDict()
        out[site] = {"scores": long, "summary": summary, "best": best, "best_params": _as_params(best), "cv_best": best["mean_test_score"]}
    return out


def rank_configs(long: DataFrame) -> DataFrame:
    """Mean/std (population) of fold scores per config; rank on mean test R2 (ties share the min rank)."""
    agg = long.groupBy("config_id").agg(
        F.avg("test_r2").alias("mean_test_score"), F.stddev_pop("test_r2").alias("std_test_score"),
        F.avg("train_r2").alias("mean_train_score"), F.stddev_pop("train_r2").alias("std_train_score"))
    # one row per configuration: a global rank over n_iter rows
    return agg.withColumn("rank_test_score", F.rank().over(Window.orderBy(F.col("mean_test_score").desc_nulls_last())))


def top_configs(summary: DataFrame, n: int = 20) -> DataFrame:
    cols = ["rank_test_score", "mean_test_score", "std_test_score"] + [
        F.col(c).cast("string").alias(f"param_rf__{c}") for c in PARAM_COLS]
    return summary.orderBy("rank_test_score", "config_id").limit(n).select(*cols)


def params_table(spark: SparkSession, params: ForestParams, extra: dict | None = None) -> DataFrame:
    """Parameter/Value table (values as strings): the parameters asked for, and what is known of the forest."""
    rows = [(k, None if v is None else str(v)) for k, v in
            [("n_estimators", params.n_estimators), ("max_depth", params.max_depth),
             ("min_samples_split", params.min_samples_split), ("min_samples_leaf", params.min_samples_leaf),
             ("max_features", params.max_features), ("max_samples", params.max_samples),
             ("random_state", params.seed)] + list((extra or {}).items())]
    return spark.createDataFrame(rows, "Parameter string, Value string")


# --------------------------------------------------------------------------
# out-of-bag scoring with explicit bagging weights
# --------------------------------------------------------------------------
def poisson_count(u, lam: float, kmax: int = 16):
    """Inverse-CDF Poisson(lam) draw from a uniform column u (JVM expression).

    For lam <= 1 a count above 16 has a probability below the resolution of
    the 30-bit uniform, so ``kmax`` never binds.
    """
    cdf, p, expr = 0.0, math.exp(-lam), None
    for k in range(kmax):
        cdf += p
        cond = u < F.lit(cdf)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
        p *= lam / (k + 1)
    return expr.otherwise(F.lit(kmax))


def bag_weight(t: int, lam: float, seed: int = C.SEED):
    """Bag count of a row in tree t: Poisson from a seeded hash of (site, Date, t)."""
    h = F.xxhash64(F.col("site"), F.col("Date"), F.lit(seed), F.lit(t))
    u = (F.abs(h % F.lit(1 << 30)).cast("double")) / F.lit(float(1 << 30))
    return poisson_count(u, lam)


def fit_bagged_forest(spark: SparkSession, train: DataFrame, features, label: str, params: ForestParams,
                      parallelism: int = 4) -> dict:
    """One-tree MLlib fits on explicit Poisson bags, so that out-of-bag rows are known.

    Tree t is fitted without MLlib's own bagging on the rows with bag count
    w_t > 0, weighted by w_t.  Returns the trees as node arrays (for
    prediction and attribution) and the bag-count expressions.
    """
    lam = float(params.max_samples) if params.max_samples else 1.0
    one = params.with_(n_estimators=1)

    def fit(t):
        w = train.withColumn("_w", bag_weight(t, lam, params.seed).cast("double")).where(F.col("_w") > 0)
        model = fit_forest(w, features, label, one.with_(seed=params.seed + t), weight_col="_w", bootstrap=False)
        return tree_arrays(spark, model)[0]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        trees = list(pool.map(fit, range(params.n_estimators)))
    return {"trees": trees, "lam": lam, "seed": params.seed}


TREES_PER_PASS = 50                # trees broadcast and evaluated in one pass over the rows


def oob_predictions(df: DataFrame, bagged: dict, features, keep=("site", "Date"),
                    per_pass: int = TREES_PER_PASS) -> DataFrame:
    """Per row: mean prediction of the trees that did not see it (NULL if every tree did).

    Bag counts are recomputed from the same hash as in fitting.  Trees are
    broadcast ``per_pass`` at a time; each pass is narrow and adds to running
    sums.
    """
    import numpy as np
    from pyspark.sql import types as T

    trees = bagged["trees"]
    keep = list(keep)
    feats = list(features)
    extra = [f for f in feats if f not in keep]
    sc = df.sparkSession.sparkContext
    cur = df.select(*keep, *extra, F.lit(0.0).alias("_num"), F.lit(0).cast("long").alias("_den"))
    for at in range(0, len(trees), per_pass):
        chunk = range(at, min(at + per_pass, len(trees)))
        bc = sc.broadcast([trees[t] for t in chunk])
        bags = F.array(*[bag_weight(t, bagged["lam"], bagged["seed"]) for t in chunk])

        def kernel(batches, bc=bc):
            ts = bc.value
            for pdf in batches:
                n = len(pdf)
                x = pdf[feats].to_numpy(dtype=float)
                w = np.stack(pdf["_bags"].to_numpy()) if n else np.zeros((0, len(ts)))
                num = pdf["_num"].to_numpy(dtype=float).copy()
                den = pdf["_den"].to_numpy(dtype=np.int64).copy()
                for j, tree in enumerate(ts):
                    oob = w[:, j] == 0
                    num += np.where(oob, tree.predict(x), 0.0)
                    den += oob
                out = pdf[keep + extra].copy()
                out["_num"] = num
                out["_den"] = den
                yield out

        schema = T.StructType(list(df.select(*keep, *extra).schema.fields)
                              + [T.StructField("_num", T.DoubleType()), T.StructField("_den", T.LongType())])
        cur = cur.select("*", bags.alias("_bags")).mapInPandas(kernel, schema)
    pred = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))
    return cur.select(*keep, pred.alias("oob_prediction"), F.col("_den").alias("oob_trees"))


def oob_score(df: DataFrame, bagged: dict, features, label: str) -> DataFrame:
    """Out-of-bag R2 over the rows with at least one out-of-bag tree (one narrow pass + one aggregate)."""
    oob = oob_predictions(df, bagged, features, keep=("site", "Date", label))
    e = F.col(label) - F.col("oob_prediction")
    return (oob.where(F.col("oob_prediction").isNotNull())
            .agg(F.count("*").alias("n_oob_rows"),
                 (F.lit(1.0) - F.sum(e * e) / F.nullif(F.var_pop(label) * F.count(e), F.lit(0.0))).alias("oob_r2")))
