"""Forests of many fits at once, as tables: growth, scores, predictions, attributions, out-of-bag rows.

A fit is a site, a feature set, parameters and a held-out fold. All fits of a
call are dealt as units of some trees each; a unit meets the blocks of its
site's code matrix in one shuffle and is finished in a task. Sites with more
rows than ``LOCAL_ROWS`` are first split level by level for all their trees
together (``forest_levels``), until every open node fits a task.

A forest is a DataFrame with one row per tree (node arrays in binary columns).
Whatever reads it joins chunks of trees to blocks of rows and adds up partial
sums, so neither a forest nor its rows are ever on the driver or broadcast.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForestParams
from ..session import scratch_path
from .codes import DICTIONARY, CodeMatrix, by_unit, unpack
from .forest import subset_size
from .growth import Tree, bag_counts, grow, predict_codes, tree_keys
from .linear_shap import shap_codes

LOCAL_ROWS = 200_000                 # rows that one task holds for a unit
TREE_ROWS = 150_000                  # trees x rows of a unit
TOGETHER = 60_000                    # trees x rows that grow together: their arrays stay in a core's cache
AHEAD_ROWS = 6_000_000               # trees x rows of the fits that a task makes one after the other
MOST_UNITS = 100_000                 # units whose (small) list is broadcast
CHUNK_NODES = 10_000                 # nodes of the trees that meet a block of rows at a time
ALL_ROWS = "all"                     # instead of a held-out fold: fit on test rows, too

ARRAYS = {"feature": np.int32, "code": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32,
          "value": np.float64, "cover": np.int64, "rows": np.int64, "gain": np.float64, "key": np.uint64}
FOREST = "fit long, site string, tree long, nodes long, leaves long, depth long, " + ", ".join(f"{a} binary" for a in ARRAYS)


@dataclass(frozen=True)
class Fit:
    """One forest: ``held_out`` is a fold, None (all training rows) or ``ALL_ROWS``; features are names of the matrix."""

    site: str
    features: tuple[str, ...]
    params: ForestParams
    held_out: int | str | None = None
    bootstrap: bool = True

    def spec(self, names: list[str]) -> dict:
        p = self.params
        return {"features": sorted(names.index(f) for f in self.features), "mtry": subset_size(p.max_features, len(self.features)),
                "depth": p.max_depth, "min_leaf": int(p.min_samples_leaf), "min_split": int(p.min_samples_split),
                "trees": int(p.n_estimators), "lam": float(p.max_samples) if p.max_samples else 1.0, "seed": int(p.seed),
                "held_out": self.held_out, "bootstrap": self.bootstrap}


def in_training(fold: np.ndarray, held_out) -> np.ndarray:
    if held_out == ALL_ROWS:
        return np.ones(len(fold), bool)
    return (fold >= 0) & (fold != (-1 if held_out is None else held_out))


def bags_of(spec: dict, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not spec["bootstrap"]:
        return np.ones((len(keys), len(ids)), np.int64)
    return bag_counts(ids, keys, spec["lam"])


def unit_trees(spec: dict, rows, first: int, last: int) -> list[Tree]:
    """Trees first .. last - 1 of a fit, on all rows of its site."""
    train = np.flatnonzero(in_training(rows.fold, spec["held_out"]))
    codes, ids, q, out = rows.codes.take(train, axis=1), rows.ids[train], rows.scale.encode(rows.y[train]), []
    step = max(1, TOGETHER // max(1, len(train)))
    for at in range(first, last, step):
        keys = tree_keys(spec["seed"], np.arange(at, min(at + step, last)))
        out += grow(codes, rows.values, q, bags_of(spec, ids, keys), keys, spec["features"], spec["mtry"], spec["depth"],
                    spec["min_leaf"], spec["min_split"], rows.scale)
    return out


def _units(matrix: CodeMatrix, fits: list[Fit]) -> list[tuple]:
    """(unit, fit, site, spec, first tree, last tree): the largest fits first."""
    out = []
    for number, fit in enumerate(fits):
        spec = fit.spec(matrix.features)
        step = max(1, TREE_ROWS // max(1, matrix.sizes.get(fit.site, 1)))
        text = json.dumps(spec)
        out += [(number, fit.site, text, at, min(at + step, spec["trees"])) for at in range(0, spec["trees"], step)]
    return [(i, *u) for i, u in enumerate(out)]


def _dealt(matrix: CodeMatrix, fits: list[Fit]) -> DataFrame:
    """Units with the blocks of their sites, sorted by (unit, block), units spread evenly over the tasks."""
    return _with_blocks(matrix, _units(matrix, fits))


def _with_blocks(matrix: CodeMatrix, units: list[tuple]) -> DataFrame:
    spark = matrix.blocks.sparkSession
    table = spark.createDataFrame(units, "unit long, fit long, site string, spec string, first long, last long")
    n = max(1, min(len(units), 20 * spark.sparkContext.defaultParallelism))
    small = F.broadcast(table) if len(units) <= MOST_UNITS else table
    return (matrix.blocks.join(small, "site").repartitionById(n, (F.col("unit") % n).cast("int"))
            .sortWithinPartitions("unit", "block"))


def _tree_row(fit: int, site: str, number: int, tree: Tree) -> tuple:
    return (fit, site, number, len(tree.left), int((tree.left < 0).sum()), tree.depth(),
            *(getattr(tree, a).astype(t).tobytes() for a, t in ARRAYS.items()))


_FOREST_NAMES = [c.split()[0] for c in FOREST.split(", ")]
_FOREST_TYPES = [pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.binary()] * len(ARRAYS)]


def _tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOREST_TYPES)], _FOREST_NAMES)


def tree_of(row: dict) -> Tree:
    """A row of a forest table as node arrays."""
    wide = lambda a, t: np.frombuffer(row[a], t).astype(np.int64 if t is np.int32 else t)
    return Tree(**{a: wide(a, t) for a, t in ARRAYS.items()})


def grow_forests(matrix: CodeMatrix, fits: list[Fit]) -> DataFrame:
    """The trees of all fits (fit = place in the list), written once below the checkpoint folder."""
    from .forest_levels import grow_large
    spark = matrix.blocks.sparkSession
    path = scratch_path(spark, "forest")

    def work(batches):
        for unit, rows in by_unit(batches):
            trees = unit_trees(json.loads(unit["spec"]), unpack(rows), unit["first"], unit["last"])
            yield _tree_batch([_tree_row(unit["fit"], unit["site"], unit["first"] + i, t) for i, t in enumerate(trees)])

    parts = []
    places = [i for i, f in enumerate(fits) if matrix.sizes[f.site] <= LOCAL_ROWS]
    if places:
        grown = _dealt(matrix, [fits[i] for i in places]).mapInArrow(work, FOREST)
        parts.append(_placed(grown, places) if len(places) < len(fits) else grown)
    large = [i for i in range(len(fits)) if i not in set(places)]
    if large:
        parts.append(_placed(grow_large(matrix, [fits[i] for i in large]), large))
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(FOREST).parquet(path)


# ------------------------------------------------------------------ scores without keeping the trees
PARTS = "fit long, block long, centre double, held_out int, trees long, sums binary, y binary, fold binary"
_PART_NAMES = [c.split()[0] for c in PARTS.split(", ")]
STATS = "fit long, what string, k long, v double"


def _part_rows(unit: dict, spec: dict, site, trees: list[Tree], n_features: int):
    """Partial sums of a unit: predictions by block, and the trees' importances as the block ``DICTIONARY``."""
    pred, scored = np.zeros(len(site.y)), np.flatnonzero(site.fold >= 0)      # no score reads the other rows
    codes = site.codes.take(scored, axis=1)
    for t in trees:
        pred[scored] += predict_codes(t, codes)
    importance = sum((t.importances(n_features) for t in trees), np.zeros(n_features))
    held_out = spec["held_out"] if isinstance(spec["held_out"], int) else -1
    out = [(unit["fit"], DICTIONARY, 0.0, held_out, len(trees), importance.tobytes(), b"", b"")]
    first, at = unit["first"] == 0, 0
    for block, n in site.blocks:
        part, at = slice(at, at + n), at + n
        out.append((unit["fit"], block, site.scale.centre, held_out, len(trees), pred[part].tobytes(),
                    site.y[part].tobytes() if first else b"", site.fold[part].tobytes() if first else b""))
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _PART_NAMES)


def _moments(y: np.ndarray, fold: np.ndarray, held_out: int, centre: float, pred: np.ndarray) -> dict[str, list[float]]:
    """Rows, sum and sum of squares of the targets about the centre, and squared error, of both sides of the fold."""
    error, y = y - pred, y - centre
    sides = {"train": in_training(fold, held_out), "test": (fold == held_out) & (fold >= 0)}
    return {side: [float(v) for v in (mine.sum(), y[mine].sum(), (y[mine] ** 2).sum(), (error[mine] ** 2).sum())]
            for side, mine in sides.items()}


def _r2(rows: float, total: float, squares: float, error: float) -> float | None:
    spread = squares - total * total / rows if rows else 0.0
    return 1.0 - error / spread if spread else None


def _add_parts(key, table):
    """Sums over the units of a fit: by feature, or the moments of both sides of the fold in one block."""
    total = sum(np.frombuffer(s) for s in table.column("sums").to_pylist())
    trees, fit, block = int(np.sum(table.column("trees").to_numpy())), *(k.as_py() for k in key)
    if block == DICTIONARY:
        out = [("importance", f, v / trees) for f, v in enumerate(total.tolist())]
    else:
        one = lambda c, t: np.frombuffer(next(v for v in table.column(c).to_pylist() if v), t)
        moments = _moments(one("y", np.float64), one("fold", np.int32), table.column("held_out")[0].as_py(),
                           table.column("centre")[0].as_py(), total / trees)
        out = [(side, k, v) for side, sums in moments.items() for k, v in enumerate(sums)]
    what, k, v = zip(*out)
    return pa.table({"fit": pa.array([fit] * len(out), pa.int64()), "what": pa.array(what), "k": pa.array(k, pa.int64()),
                     "v": pa.array(v, pa.float64())})


def score_fits(matrix: CodeMatrix, fits: list[Fit]) -> DataFrame:
    """(fit, train_r2, test_r2, importances): R2 on the rows of the fit and on its held-out fold, one row per fit.

    ``importances`` lists (feature number, mean normalised impurity decrease). No tree is written.
    """
    p = len(matrix.features)

    def work(batches):
        for unit, rows in by_unit(batches):
            spec, site = json.loads(unit["spec"]), unpack(rows)
            yield _part_rows(unit, spec, site, unit_trees(spec, site, unit["first"], unit["last"]), p)

    small = [i for i, f in enumerate(fits) if matrix.sizes[f.site] <= LOCAL_ROWS]
    out = []
    if small:
        scored = _scores(_dealt(matrix, [fits[i] for i in small]).mapInArrow(work, PARTS))
        out.append(_placed(scored, small) if len(small) < len(fits) else scored)
    large = [i for i, f in enumerate(fits) if matrix.sizes[f.site] > LOCAL_ROWS]
    if large:
        out.append(_placed(_score_table(matrix, [fits[i] for i in large]), large))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


AHEAD = "fit long, features array<string>, train_r2 double, test_r2 double, importances array<struct<k:bigint,v:double>>"
_AHEAD = pa.schema([("fit", pa.int64()), ("features", pa.list_(pa.string())), ("train_r2", pa.float64()), ("test_r2", pa.float64()),
                    ("importances", pa.list_(pa.struct([("k", pa.int64()), ("v", pa.float64())])))])


def _whole_score(fit: Fit, names: list[str], site) -> tuple:
    """(train R2, test R2, importances by feature number) of a fit whose trees are all grown in this task."""
    spec, total, importance = fit.spec(names), 0, 0
    held_out = spec["held_out"] if isinstance(spec["held_out"], int) else -1
    scored, step = np.flatnonzero(site.fold >= 0), max(1, TREE_ROWS // max(1, len(site.y)))
    codes = site.codes.take(scored, axis=1)
    for at in range(0, spec["trees"], step):
        trees = unit_trees(spec, site, at, min(at + step, spec["trees"]))
        pred = np.zeros(len(scored))
        for t in trees:
            pred += predict_codes(t, codes)
        total = total + pred
        importance = importance + sum((t.importances(len(names)) for t in trees), np.zeros(len(names)))
    sides = _moments(site.y[scored], site.fold[scored], held_out, site.scale.centre, total / spec["trees"])
    return _r2(*sides["train"]), _r2(*sides["test"]), (importance / spec["trees"]).tolist()


def steps_ahead(matrix: CodeMatrix, fits: list[Fit]) -> int:
    """How many fits a task makes one after the other of each of these, so that its work stays bounded."""
    return AHEAD_ROWS // max(1, *(matrix.sizes[f.site] * f.params.n_estimators for f in fits))


def score_ahead(matrix: CodeMatrix, fits: list[Fit], following, steps: int) -> DataFrame:
    """Scores of each fit and of up to ``steps`` - 1 fits after it: ``following(fit, importances)`` is the next one, or None.

    One row a fit made: the number of the first one, its features and what ``score_fits`` tells.
    """
    names = list(matrix.features)
    units = [(i, i, f.site, "", 0, f.params.n_estimators) for i, f in enumerate(fits)]

    def work(batches):
        for unit, rows in by_unit(batches):
            fit, site, out = fits[unit["fit"]], unpack(rows), []
            while fit is not None and len(out) < steps:
                train, test, gains = _whole_score(fit, names, site)
                out.append({"fit": unit["fit"], "features": list(fit.features), "train_r2": train, "test_r2": test,
                            "importances": [{"k": k, "v": v} for k, v in enumerate(gains)]})
                fit = following(fit, {names[k]: v for k, v in enumerate(gains)})
            yield pa.RecordBatch.from_pylist(out, _AHEAD)

    return _with_blocks(matrix, units).mapInArrow(work, AHEAD)


def _placed(table: DataFrame, places: list[int]) -> DataFrame:
    """Numbers of a part of the fits replaced by their places in the whole list."""
    place = F.element_at(F.array(*[F.lit(i) for i in places]), (F.col("fit") + 1).cast("int")).cast("long")
    return table.withColumn("fit", place)


def _score_table(matrix: CodeMatrix, fits: list[Fit]) -> DataFrame:
    """``score_fits`` through forest tables, for sites whose rows fit no task."""
    forest = grow_forests(matrix, fits)
    held_out = F.element_at(F.array(*[F.lit(f.held_out if isinstance(f.held_out, int) else None).cast("int") for f in fits]),
                            (F.col("fit") + 1).cast("int"))
    rows = predictions(matrix, forest).withColumn("k", held_out)
    is_test = F.col("fold") == F.col("k")
    is_train = (F.col("fold") >= 0) & ~F.coalesce(is_test, F.lit(False))

    def r2(mine):
        y, e = F.when(mine, F.col("y")), F.when(mine, F.col("y") - F.col("Predicted_NEE"))
        return F.lit(1.0) - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))

    scores = rows.groupBy("fit").agg(r2(is_train).alias("train_r2"), r2(is_test).alias("test_r2"))
    listed = importances(forest, matrix).groupBy("fit").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("importances"))
    return scores.join(listed, "fit")


def _scores(parts: DataFrame) -> DataFrame:
    stats = parts.groupBy("fit", "block").applyInArrow(_add_parts, STATS).groupBy("fit", "what", "k").agg(F.sum("v").alias("v"))
    of = lambda what, k: F.sum(F.when((F.col("what") == what) & (F.col("k") == k), F.col("v")))
    moments = {(s, k): of(s, k).alias(f"{s}{k}") for s in ("train", "test") for k in range(4)}
    wide = stats.groupBy("fit").agg(*moments.values(), F.sort_array(F.collect_list(
        F.when(F.col("what") == "importance", F.struct("k", "v")))).alias("importances"))
    r2 = lambda s: (F.lit(1.0) - F.col(f"{s}3") / F.nullif(
        F.col(f"{s}2") - F.col(f"{s}1") * F.col(f"{s}1") / F.nullif(F.col(f"{s}0"), F.lit(0.0)), F.lit(0.0)))
    return wide.select("fit", r2("train").alias("train_r2"), r2("test").alias("test_r2"), "importances")


# ------------------------------------------------------------------ what is read from a forest table
def importances(forest: DataFrame, matrix: CodeMatrix) -> DataFrame:
    """(fit, site, k, v): mean over trees of each tree's normalised gains, by feature number (summing to 1)."""
    p = len(matrix.features)

    def work(batches):
        for batch in batches:
            rows = [(r["fit"], r["site"], tree_of(r).importances(p)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))], ["fit", "site", "gains"])

    mean = (forest.mapInArrow(work, "fit long, site string, gains array<double>")
            .select("fit", "site", F.posexplode("gains").alias("k", "v"))
            .groupBy("fit", "site", "k").agg(F.sum("v").alias("v")))
    whole = F.sum("v").over(Window.partitionBy("fit"))                 # one row a feature
    return mean.withColumn("v", F.when(whole > 0, F.col("v") / whole).otherwise(F.lit(0.0))).withColumn("k", F.col("k").cast("long"))


def forest_importance(forest: DataFrame, matrix: CodeMatrix, features) -> DataFrame:
    """(fit, site, Feature, Importance, rank): largest first; only the given features."""
    names = F.element_at(F.array(*[F.lit(f) for f in matrix.features]), (F.col("k") + 1).cast("int"))
    w = Window.partitionBy("fit").orderBy(F.desc("Importance"), F.col("Feature"))
    return (importances(forest, matrix).select("fit", "site", names.alias("Feature"), F.col("v").alias("Importance"))
            .where(F.col("Feature").isin(list(features))).withColumn("rank", F.row_number().over(w)))


def _chunks(forest: DataFrame) -> DataFrame:
    """(fit, site, chunk, trees): the trees of a fit, about ``CHUNK_NODES`` nodes in a row."""
    before = F.sum("nodes").over(Window.partitionBy("fit").orderBy("tree")) - F.col("nodes")
    return (forest.withColumn("chunk", F.floor(before / CHUNK_NODES)).groupBy("fit", "site", "chunk")
            .agg(F.collect_list(F.struct("tree", *ARRAYS)).alias("trees")))


SUMS = "fit long, site string, block long, sums binary, days binary, y binary, fold binary"
_SUM_NAMES = [c.split()[0] for c in SUMS.split(", ")]


def by_row(matrix: CodeMatrix, forest: DataFrame, kernel, names: list[str], test_only=()) -> DataFrame:
    """(fit, site, Date, y, fold, *names): per row the sums over a fit's trees of what ``kernel(trees, block)`` gives.

    The kernel sees the trees of one chunk and one block of rows and returns a (name, row) array. Of the fits in
    ``test_only`` it sees the rows outside the training part.
    """
    test_only = frozenset(test_only)
    spark, k = forest.sparkSession, len(names)
    blocks = matrix.blocks.where(F.col("block") != DICTIONARY).drop("centre", "spread", "site_rows")
    n = 4 * spark.sparkContext.defaultParallelism
    pairs = _chunks(forest).join(blocks, "site").repartition(n, "fit", "chunk", "block")

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["fit"] in test_only:
                    row = _test_rows(row)
                sums = kernel([tree_of(t) for t in row["trees"]], row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["fit"]], pa.int64()), pa.array([row["site"]], pa.string()), pa.array([row["block"]], pa.int64()),
                     *(pa.array([b], pa.binary()) for b in (np.ascontiguousarray(sums).tobytes(), row["days"], row["y"], row["fold"]))],
                    _SUM_NAMES)

    def add(key, table):
        total = sum(np.frombuffer(s).reshape(k, -1) for s in table.column("sums").to_pylist())
        one = lambda c, t: np.frombuffer(table.column(c)[0].as_py(), t)
        n_rows = total.shape[1]
        return pa.table({"fit": pa.array([key[0].as_py()] * n_rows, pa.int64()), "site": pa.array([table.column("site")[0].as_py()] * n_rows),
                         "day": one("days", np.int32), "y": one("y", np.float64), "fold": one("fold", np.int32),
                         **{c: np.ascontiguousarray(total[j]) for j, c in enumerate(names)}})

    schema = "fit long, site string, day int, y double, fold int, " + ", ".join(f"`{c}` double" for c in names)
    return (pairs.mapInArrow(work, SUMS).groupBy("fit", "block").applyInArrow(add, schema)
            .select("fit", "site", F.date_from_unix_date("day").alias("Date"), "y", "fold", *names))


def _test_rows(row: dict) -> dict:
    """A block without its training rows."""
    mine = np.frombuffer(row["fold"], np.int32) < 0
    cut = lambda c, t: np.frombuffer(row[c], t)[mine].tobytes()
    codes = np.ascontiguousarray(_block_codes(row)[:, mine]).tobytes()
    return row | {"n": int(mine.sum()), "codes": codes, "ids": cut("ids", np.int64), "days": cut("days", np.int32),
                  "y": cut("y", np.float64), "fold": cut("fold", np.int32)}


def _block_codes(row: dict) -> np.ndarray:
    return np.frombuffer(row["codes"], np.uint16).reshape(-1, row["n"])


def predictions(matrix: CodeMatrix, forest: DataFrame) -> DataFrame:
    """(fit, site, Date, y, fold, Predicted_NEE): the mean prediction of each fit's trees, all rows of its site."""
    def kernel(trees, row):
        codes = _block_codes(row)
        return np.stack([sum(predict_codes(t, codes) for t in trees), np.full(row["n"], float(len(trees)))])

    return (by_row(matrix, forest, kernel, ["sum", "trees"])
            .select("fit", "site", "Date", "y", "fold", (F.col("sum") / F.col("trees")).alias("Predicted_NEE")))


def attributions(matrix: CodeMatrix, forest: DataFrame, features, test_only=()) -> DataFrame:
    """(fit, site, Date, y, fold, SHAP_<f>, Predicted_NEE, base_value): base_value + the sum of SHAP = Predicted_NEE."""
    places, features = [matrix.features.index(f) for f in features], list(features)

    def kernel(trees, row):
        phi, pred, base = shap_codes(trees, _block_codes(row))
        return np.concatenate([phi[places], [pred, np.full(row["n"], base), np.full(row["n"], float(len(trees)))]])

    names = [*(f"SHAP_{f}" for f in features), "Predicted_NEE", "base_value"]
    return by_row(matrix, forest, kernel, [*names, "trees"], test_only).select(
        "fit", "site", "Date", "y", "fold", *[(F.col(c) / F.col("trees")).alias(c) for c in names])


def out_of_bag(matrix: CodeMatrix, forest: DataFrame, fits: list[Fit]) -> DataFrame:
    """(fit, site, Date, y, oob_prediction, oob_trees): training rows, scored by the trees whose bag has no draw of them.

    The bags are those of the growth itself: the same hash of tree key and row id.
    """
    specs = [f.spec(matrix.features) for f in fits]

    def kernel(trees, row):
        codes, ids, spec = _block_codes(row), np.frombuffer(row["ids"], np.int64), specs[row["fit"]]
        bags = bags_of(spec, ids, np.array([t.key[0] for t in trees], np.uint64))
        unseen = bags == 0
        values = np.stack([predict_codes(t, codes) for t in trees])
        train = in_training(np.frombuffer(row["fold"], np.int32), spec["held_out"])
        return np.stack([np.where(unseen, values, 0.0).sum(0), unseen.sum(0).astype(float), train.astype(float) * len(trees)])

    rows = by_row(matrix, forest, kernel, ["sum", "n", "trained"]).where("trained > 0")
    return rows.select("fit", "site", "Date", "y", F.when(F.col("n") > 0, F.col("sum") / F.col("n")).alias("oob_prediction"),
                       F.col("n").cast("long").alias("oob_trees"))


def oob_score(oob: DataFrame) -> DataFrame:
    """(fit, site, n_oob_rows, oob_r2) over the rows that some tree has not seen."""
    e = F.col("y") - F.col("oob_prediction")
    return (oob.where(F.col("oob_prediction").isNotNull()).groupBy("fit", "site").agg(
        F.count(F.lit(1)).alias("n_oob_rows"),
        (F.lit(1.0) - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("oob_r2")))
