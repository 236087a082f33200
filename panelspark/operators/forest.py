"""Random-forest regression on Spark MLlib: fit, predict, importance, node table.

The forest itself is MLlib's distributed ``RandomForestRegressor``; this
module maps the analysis' parameter vocabulary onto it and exposes the
fitted trees as a node table (for attribution).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ForestParams
from ..session import scratch_path

MAX_DEPTH = 30          # deepest tree MLlib grows


def subset_size(max_features, p: int) -> int:
    """Number of candidate features per split, as the analysis defines it."""
    if max_features in (None, "all", 1.0):
        return p
    if max_features == "sqrt":
        return max(1, int(math.sqrt(p)))
    if max_features == "log2":
        return max(1, int(math.log2(p)))
    if isinstance(max_features, float):
        return max(1, int(max_features * p))
    if isinstance(max_features, int):
        return max(1, min(p, max_features))
    raise ValueError(f"unsupported max_features {max_features!r}")


def mllib_params(params: ForestParams, p: int) -> dict:
    """MLlib settings for the given forest parameters and feature count.

    * depth: None or deeper than MLlib's limit -> 30;
    * candidate features: exact integer count (MLlib's own names round up);
    * bagging fraction: ``max_samples`` (Poisson bagging), 1.0 when unset;
    * ``min_samples_split`` has no MLlib counterpart: see ``fit_forest``.
    """
    depth = effective_depth(params)
    return dict(
        numTrees=int(params.n_estimators),
        maxDepth=depth,
        featureSubsetStrategy=str(subset_size(params.max_features, p)),
        minInstancesPerNode=int(params.min_samples_leaf),
        subsamplingRate=float(params.max_samples) if params.max_samples else 1.0,
        maxBins=int(params.max_bins),
        seed=int(params.seed),
        bootstrap=True,
        cacheNodeIds=True,          # ship row-to-node ids, not the growing trees, with every level
        maxMemoryInMB=1024,         # one node group, so one pass over the rows, per level
    )


def effective_depth(params: ForestParams) -> int:
    """The depth that is grown: MLlib stops at 30, also for unlimited or deeper requests."""
    return MAX_DEPTH if params.max_depth is None else min(int(params.max_depth), MAX_DEPTH)


def needs_pruning(params: ForestParams) -> bool:
    """A node needs 2 x ``min_samples_leaf`` rows to split anyway; a larger split count cuts nodes off."""
    return int(params.min_samples_split) > 2 * int(params.min_samples_leaf)


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def fit_forest(df: DataFrame, features, label: str, params: ForestParams, weight_col: str | None = None,
               bootstrap: bool = True):
    """Fit on the rows of ``df`` (features assembled on the fly).

    Returns MLlib's model, or a ``PrunedForest`` when ``min_samples_split``
    matters: nodes with fewer (bagged) rows than that become leaves, which is
    the tree that a grower with the rule would have stopped at.
    """
    kw = mllib_params(params, len(features))
    if not bootstrap:
        kw.update(bootstrap=False, subsamplingRate=1.0)
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="Predicted_NEE", **kw)
    if weight_col:
        rf = rf.setWeightCol(weight_col)
    model = rf.fit(assemble(df, features))
    if not needs_pruning(params):
        return model
    return PrunedForest([t.pruned(int(params.min_samples_split)) for t in tree_arrays(df.sparkSession, model)], len(features))


def predict_forest(model, df: DataFrame, features) -> DataFrame:
    """Add ``Predicted_NEE`` (the model is broadcast to the tasks)."""
    if isinstance(model, PrunedForest):
        return predict_trees(df, model.trees, features)
    return model.transform(assemble(df, features)).drop("features")


def predict_trees(df: DataFrame, trees: list[TreeArrays], features) -> DataFrame:
    """Mean prediction of node arrays, one narrow pass."""
    features, columns = list(features), df.columns
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def kernel(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            out = pdf[columns].copy()
            out["Predicted_NEE"] = np.mean([t.predict(x) for t in shared.value], axis=0) if len(x) else np.zeros(0)
            yield out

    return df.mapInPandas(kernel, T.StructType([*df.schema.fields, T.StructField("Predicted_NEE", T.DoubleType())]))


def importances(model) -> list[float]:
    """Impurity importance of each feature, in feature order (sums to 1)."""
    if isinstance(model, PrunedForest):
        return model.importances()
    return model.featureImportances.toArray().tolist()


def forest_importance(spark: SparkSession, model, features) -> DataFrame:
    """Impurity importance per feature (sums to 1), largest first, with rank."""
    rows = [(f, float(v)) for f, v in zip(features, importances(model))]
    df = spark.createDataFrame(rows, "Feature string, Importance double")
    # one row per feature: the global order runs on a table of p rows
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("Importance"), F.col("Feature"))))


@dataclass
class TreeArrays:
    """One tree as flat arrays indexed by node id (MLlib's pre-order ids)."""

    feature: np.ndarray      # split feature index, -1 at leaves
    threshold: np.ndarray    # x <= threshold goes left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray        # node prediction (mean label of its rows)
    cover: np.ndarray        # weighted row count of the node
    gain: np.ndarray         # impurity decrease of the split

    def pruned(self, min_split: int) -> "TreeArrays":
        """Nodes with fewer rows than ``min_split`` become leaves (their subtrees are unreachable)."""
        cut = (self.left >= 0) & (self.cover < min_split)
        stop = lambda a: np.where(cut, -1, a)
        return TreeArrays(stop(self.feature), self.threshold, stop(self.left), stop(self.right), self.value, self.cover,
                          self.gain)

    def reachable(self) -> np.ndarray:
        seen, stack = np.zeros(len(self.left), bool), [0]
        while stack:
            node = stack.pop()
            seen[node] = True
            if self.left[node] >= 0:
                stack += (int(self.left[node]), int(self.right[node]))
        return seen

    def predict(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = self.left[node] >= 0
            if not inner.any():
                return self.value[node]
            go_left = x[rows, np.where(inner, self.feature[node], 0)] <= self.threshold[node]
            node = np.where(inner, np.where(go_left, self.left[node], self.right[node]), node)


@dataclass
class PrunedForest:
    """A fitted forest as node arrays."""

    trees: list[TreeArrays]
    n_features: int

    def importances(self) -> list[float]:
        """Mean over trees of each tree's normalised gain x rows, normalised (MLlib's definition)."""
        total = np.zeros(self.n_features)
        for t in self.trees:
            split = t.reachable() & (t.left >= 0)
            own = np.bincount(t.feature[split], t.gain[split] * t.cover[split], self.n_features)
            total += own / own.sum() if own.sum() > 0 else 0.0
        return (total / total.sum() if total.sum() > 0 else total).tolist()


def node_table(spark: SparkSession, model: RandomForestRegressionModel) -> DataFrame:
    """The fitted trees as a DataFrame (treeID, nodeData struct), read from the saved model."""
    path = scratch_path(spark, "forest-model")
    model.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data")


def tree_arrays(spark: SparkSession, model) -> list[TreeArrays]:
    """Node arrays of every tree.

    The model already lives on the driver (MLlib keeps fitted trees there and
    broadcasts them for prediction), so its node table is brought back too;
    its size is bounded by numTrees x 2^(maxDepth+1) and by the rows.
    """
    if isinstance(model, PrunedForest):
        return model.trees
    nodes = (node_table(spark, model)
             .select("treeID", F.col("nodeData.id").alias("id"),
                     F.col("nodeData.prediction").alias("value"),
                     F.try_element_at(F.col("nodeData.impurityStats"), F.lit(1)).alias("cover"),
                     F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                     F.col("nodeData.gain").alias("gain"),
                     F.col("nodeData.split.featureIndex").alias("feature"),
                     F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"))
             .toPandas())
    out = []
    for _, t in nodes.sort_values(["treeID", "id"]).groupby("treeID", sort=True):
        n = int(t["id"].max()) + 1
        arr = {k: np.zeros(n, dtype=float) for k in ("threshold", "value", "cover", "gain")}
        ints = {k: np.full(n, -1, dtype=np.int64) for k in ("feature", "left", "right")}
        ids = t["id"].to_numpy()
        for k in arr:
            arr[k][ids] = t[k].fillna(0.0).to_numpy(dtype=float)
        for k in ints:
            ints[k][ids] = t[k].fillna(-1).to_numpy(dtype=np.int64)
        leaf = ints["left"] < 0
        ints["feature"][leaf] = -1
        out.append(TreeArrays(ints["feature"], arr["threshold"], ints["left"], ints["right"],
                              arr["value"], arr["cover"], arr["gain"]))
    return out
