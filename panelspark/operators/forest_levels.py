"""Level-synchronous growth of the trees of sites whose rows fit no task.

All trees of all fits grow one level per job. Rows stay in their blocks: a task
draws the bags of its rows anew (they are hashes), walks the nodes that exist
and counts, for every open node and candidate feature, draws and targets by
code. One merge by (fit, tree, node) adds the counts and chooses the split by
the same rule as ``growth``; the splits are joined to the trees for the next
level. A node of at most ``forests.LOCAL_ROWS`` rows sends its rows to one task,
which finishes the subtree. Sums are exact integers, so the trees are the same
as if one task had grown them.

Trees between levels are a table, one row per tree. The driver only asks
whether a node is still open.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import forests as FS
from .codes import DICTIONARY, CodeMatrix, by_unit
from .growth import Scale, Tree, UNLIMITED, candidate_order, child_keys, grow, tree_keys

LEAF, SPLIT, OPEN, LOCAL = 0, 1, 2, 3
#: Node columns of a growing tree; ``turn`` is how often no candidate could split the node.
TOP = FS.ARRAYS | {"level": np.int32, "state": np.int8, "turn": np.int32}
TOPS = "fit long, site string, tree long, spec string, " + ", ".join(f"{a} binary" for a in TOP)
COUNTS = ("fit long, site string, tree long, node int, feature int, codes binary, n binary, w binary, wy binary, low long, "
          "high long, turn int, level int, spec string")
CHOSEN = ("fit long, site string, tree long, node int, outcome int, feature int, code int, after int, rows long, cover long, "
          "wy long, score double")


def _nodes(row: dict) -> dict[str, np.ndarray]:
    return {a: np.frombuffer(row[a], t) for a, t in TOP.items()}


def _roots(matrix: CodeMatrix, fits: list) -> DataFrame:
    spark = matrix.blocks.sparkSession
    fits_table = spark.createDataFrame([(i, f.site, json.dumps(f.spec(matrix.features)), int(f.params.n_estimators))
                                        for i, f in enumerate(fits)], "fit long, site string, spec string, trees int")

    def root(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                node = {a: np.zeros(1, t) for a, t in TOP.items()}
                node |= {"feature": np.array([-1], np.int32), "left": np.array([-1], np.int32), "right": np.array([-1], np.int32),
                         "key": tree_keys(json.loads(r["spec"])["seed"], np.array([r["tree"]])), "state": np.array([OPEN], np.int8)}
                out.append((r["fit"], r["site"], r["tree"], r["spec"], *(node[a].astype(t).tobytes() for a, t in TOP.items())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["fit", "site", "tree", "spec", *TOP])

    return (fits_table.select("fit", "site", "spec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees").cast("long") - 1)).alias("tree"))
            .mapInArrow(root, TOPS))


def _meet(matrix: CodeMatrix, tops: DataFrame, state: int) -> DataFrame:
    """Blocks of a site with chunks of its trees that have nodes in the given state."""
    waiting = F.udf(lambda s: bool((np.frombuffer(s, np.int8) == state).any()), "boolean")   # one call a tree
    before = F.sum(F.octet_length("state")).over(Window.partitionBy("fit").orderBy("tree"))
    chunks = (tops.where(waiting("state")).withColumn("chunk", F.floor(before / FS.CHUNK_NODES)).groupBy("fit", "site", "chunk")
              .agg(F.collect_list(F.struct("tree", "spec", *TOP)).alias("trees")))
    blocks = matrix.blocks.where(F.col("block") != DICTIONARY)
    n = 4 * tops.sparkSession.sparkContext.defaultParallelism
    return chunks.join(blocks, "site").repartition(n, "fit", "chunk", "block")


def _drawn(row: dict, top: dict):
    """(spec, nodes, rows of the block in the bag, their draws, node of each) of one tree in one block."""
    spec, nodes = json.loads(top["spec"]), _nodes(top)
    codes = np.frombuffer(row["codes"], np.uint16).reshape(-1, row["n"])
    bags = FS.bags_of(spec, np.frombuffer(row["ids"], np.int64), nodes["key"][:1])[0]
    mine = np.flatnonzero(FS.in_training(np.frombuffer(row["fold"], np.int32), spec["held_out"]) & (bags > 0))
    node = np.zeros(len(mine), np.int64)
    while True:
        inner = np.flatnonzero(nodes["left"][node] >= 0)
        if not len(inner):
            return spec, nodes, codes, mine, bags[mine], node
        here = node[inner]
        go_left = codes[nodes["feature"][here], mine[inner]] <= nodes["code"][here]
        node[inner] = np.where(go_left, nodes["left"][here], nodes["right"][here])


def _counts(matrix: CodeMatrix, tops: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q, out = Scale.of(row["centre"], row["spread"], row["site_rows"]).encode(np.frombuffer(row["y"])), []
                for top in row["trees"]:
                    spec, nodes, codes, mine, w, node = _drawn(row, top)
                    features = np.array(spec["features"], np.int64)
                    for k in np.unique(node):
                        if nodes["state"][k] != OPEN:
                            continue
                        here, turn = np.flatnonzero(node == k), int(nodes["turn"][k])
                        order = candidate_order(nodes["key"][k:k + 1], features)[0][turn * spec["mtry"]:(turn + 1) * spec["mtry"]]
                        targets = q[mine[here]]
                        for f in order.tolist():
                            found, at, n = np.unique(codes[f, mine[here]], return_inverse=True, return_counts=True)
                            sums = [np.zeros(len(found), np.int64) for _ in range(2)]
                            np.add.at(sums[0], at, w[here])
                            np.add.at(sums[1], at, w[here] * targets)
                            out.append((row["fit"], row["site"], top["tree"], int(k), f, found.tobytes(), n.astype(np.int64).tobytes(),
                                        sums[0].tobytes(), sums[1].tobytes(), int(targets.min()), int(targets.max()), turn,
                                        int(nodes["level"][k]), top["spec"]))
                if out:
                    names = [c.split()[0] for c in COUNTS.split(", ")]
                    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64(),
                             pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return _meet(matrix, tops, OPEN).mapInArrow(count, COUNTS)


def _choose(key, table):
    """The merge of one node: its counts over all blocks, and the split or the end of it."""
    rows = table.to_pylist()
    spec, turn, level = json.loads(rows[0]["spec"]), rows[0]["turn"], rows[0]["level"]
    best, total, valid = None, None, 0
    smallest = max(spec["min_split"], 2 * spec["min_leaf"])
    for f in sorted({r["feature"] for r in rows}):
        mine = [r for r in rows if r["feature"] == f]
        codes, at = np.unique(np.concatenate([np.frombuffer(r["codes"], np.uint16) for r in mine]), return_inverse=True)
        n, w, wy = (np.zeros(len(codes), np.int64) for _ in range(3))
        for sums, c in ((n, "n"), (w, "w"), (wy, "wy")):
            np.add.at(sums, at, np.concatenate([np.frombuffer(r[c], np.int64) for r in mine]))
        total = (int(n.sum()), int(w.sum()), int(wy.sum()))
        left = np.cumsum(n)[:-1]
        at = np.flatnonzero((left >= spec["min_leaf"]) & (total[0] - left >= spec["min_leaf"]))
        if len(at):
            lw, lwy = np.cumsum(w)[at], np.cumsum(wy)[at]
            score = lwy.astype(float) ** 2 / lw + (total[2] - lwy).astype(float) ** 2 / (total[1] - lw)
            i = int(np.argmax(score))
            if best is None or score[i] > best[0]:
                best = (float(score[i]), f, int(codes[at[i]]), int(codes[at[i] + 1]))
    limit = UNLIMITED if spec["depth"] is None else spec["depth"]
    if total[0] <= FS.LOCAL_ROWS:
        outcome = LOCAL
    elif level >= limit or total[0] < smallest or min(r["low"] for r in rows) == max(r["high"] for r in rows):
        outcome = LEAF
    elif best is not None:
        outcome = SPLIT
    else:
        outcome = OPEN if (turn + 1) * spec["mtry"] < len(spec["features"]) else LEAF
    score, f, code, after = best if outcome == SPLIT else (0.0, -1, 0, 0)
    out = {"fit": rows[0]["fit"], "site": rows[0]["site"], "tree": rows[0]["tree"], "node": rows[0]["node"], "outcome": outcome,
           "feature": f, "code": code, "after": after, "rows": total[0], "cover": total[1], "wy": total[2], "score": score}
    return pa.Table.from_pydict({c.split()[0]: pa.array([out[c.split()[0]]], {"long": pa.int64(), "string": pa.string(), "int": pa.int32(),
                                                        "double": pa.float64()}[c.split()[1]]) for c in CHOSEN.split(", ")})


def _thresholds(matrix: CodeMatrix, chosen: DataFrame) -> DataFrame:
    """The chosen splits with their threshold, the last code that goes left, and the site's scale."""
    def values(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["ids"], np.int64)
                for f, v in enumerate(np.split(np.frombuffer(r["codes"]), np.cumsum(sizes)[:-1])):
                    yield pa.RecordBatch.from_arrays([pa.array([r["site"]] * len(v)), pa.array([f] * len(v), pa.int32()),
                                                      pa.array(range(len(v)), pa.int32()), pa.array(v)], ["site", "feature", "place", "value"])

    heads = matrix.blocks.where(F.col("block") == DICTIONARY)
    known = heads.select("site", "ids", "codes").mapInArrow(values, "site string, feature int, place int, value double")
    between = (chosen.where(F.col("outcome") == SPLIT).join(known, ["site", "feature"])
               .where((F.col("place") >= F.col("code")) & (F.col("place") <= F.col("after")))
               .groupBy("fit", "tree", "node").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")))
    low, high = F.element_at("v", 1)["value"], F.element_at("v", -1)["value"]
    mid = low / 2 + high / 2
    between = between.withColumn("threshold", F.when((mid >= high) | (mid < low), low).otherwise(mid))
    last = F.array_max(F.transform(F.filter("v", lambda x: x["value"] <= F.col("threshold")), lambda x: x["place"]))
    between = between.select("fit", "tree", "node", "threshold", last.alias("last"))
    return (chosen.join(between, ["fit", "tree", "node"], "left")
            .join(heads.select("site", "centre", "spread", "site_rows"), "site"))


def _applied(tops: DataFrame, chosen: DataFrame) -> DataFrame:
    """The trees with the outcomes of a level."""
    def apply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        nodes = {a: x.copy() for a, x in _nodes(row).items()}
        grown = {a: [x] for a, x in nodes.items()}
        n = len(nodes["left"])
        for r in right.sort_values("node").itertuples():
            scale, k = Scale.of(r.centre, r.spread, r.site_rows), r.node
            nodes["rows"][k], nodes["cover"][k], nodes["value"][k] = r.rows, r.cover, scale.centre + scale.unit * (r.wy / r.cover)
            if r.outcome == OPEN:
                nodes["turn"][k] += 1
                continue
            nodes["state"][k] = r.outcome
            if r.outcome != SPLIT:
                continue
            nodes["feature"][k], nodes["code"][k], nodes["threshold"][k] = r.feature, r.last, r.threshold
            nodes["gain"][k] = max(r.score - float(r.wy) ** 2 / r.cover, 0) / r.cover * scale.unit ** 2
            nodes["left"][k], nodes["right"][k] = n, n + 1
            child = {a: np.zeros(2, t) for a, t in TOP.items()}
            for a in ("feature", "left", "right"):
                child[a][:] = -1
            child["key"] = np.concatenate(child_keys(nodes["key"][k:k + 1]))
            child["level"][:], child["state"][:] = nodes["level"][k] + 1, OPEN
            for a in TOP:
                grown[a].append(child[a])
            n += 2
        return pd.DataFrame([{**{c: row[c] for c in ("fit", "site", "tree", "spec")},
                              **{a: np.concatenate(x).astype(TOP[a]).tobytes() for a, x in grown.items()}}])

    return tops.groupBy("fit", "tree").cogroup(chosen.groupBy("fit", "tree")).applyInPandas(apply, TOPS)


def _finished(matrix: CodeMatrix, tops: DataFrame) -> DataFrame:
    """(fit, tree, node, subtree arrays) of the nodes that one task can hold."""
    moved = "unit string, fit long, tree long, node int, level int, key long, spec string, block long, q binary, w binary, ids binary, " \
            "codes binary, centre double, spread double, site_rows long, site string"
    names = [c.split()[0] for c in moved.split(", ")]

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q = Scale.of(row["centre"], row["spread"], row["site_rows"]).encode(np.frombuffer(row["y"]))
                for top in row["trees"]:
                    spec, nodes, codes, mine, w, node = _drawn(row, top)
                    for k in np.unique(node):
                        if nodes["state"][k] == LOCAL:
                            here = mine[node == k]
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                                (f"{row['fit']}/{top['tree']}/{k}", pa.string()), (row["fit"], pa.int64()), (top["tree"], pa.int64()),
                                (int(k), pa.int32()), (int(nodes["level"][k]), pa.int32()), (int(nodes["key"][k:k + 1].view(np.int64)[0]), pa.int64()),
                                (top["spec"], pa.string()), (row["block"], pa.int64()), (q[here].tobytes(), pa.binary()),
                                (w[node == k].tobytes(), pa.binary()), (b"", pa.binary()),
                                (np.ascontiguousarray(codes[:, here]).tobytes(), pa.binary()), (row["centre"], pa.float64()),
                                (row["spread"], pa.float64()), (row["site_rows"], pa.int64()), (row["site"], pa.string()))], names)

    sent = _meet(matrix, tops, LOCAL).mapInArrow(send, moved)
    units = sent.select("unit", "fit", "tree", "node", "level", "key", "spec", "site").distinct()
    heads = matrix.blocks.where(F.col("block") == DICTIONARY).select("site", "block", "ids", "codes", "centre", "spread", "site_rows")
    empty = F.lit(b"").cast("binary")
    heads = units.join(heads, "site").withColumn("q", empty).withColumn("w", empty).select(*names)

    def finish(batches):
        for unit, rows in by_unit(batches):
            head, body = rows[0], rows[1:]
            spec, sizes = json.loads(head["spec"]), np.frombuffer(head["ids"], np.int64)
            values = np.split(np.frombuffer(head["codes"]), np.cumsum(sizes)[:-1])
            join = lambda c: np.concatenate([np.frombuffer(r[c], np.int64) for r in body])
            codes = np.concatenate([np.frombuffer(r["codes"], np.uint16).reshape(len(sizes), -1) for r in body], axis=1)
            tree = grow(codes, values, join("q"), join("w")[None, :], np.array([head["key"]], np.int64).view(np.uint64), spec["features"],
                        spec["mtry"], spec["depth"], spec["min_leaf"], spec["min_split"],
                        Scale.of(head["centre"], head["spread"], head["site_rows"]), head["level"])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([head["fit"]], pa.int64()), pa.array([head["tree"]], pa.int64()), pa.array([head["node"]], pa.int32()),
                 *(pa.array([getattr(tree, a).astype(t).tobytes()], pa.binary()) for a, t in FS.ARRAYS.items())],
                ["fit", "tree", "node", *FS.ARRAYS])

    n = 4 * tops.sparkSession.sparkContext.defaultParallelism
    return (sent.unionByName(heads).repartition(n, "unit").sortWithinPartitions("unit", "block")
            .mapInArrow(finish, "fit long, tree long, node int, " + ", ".join(f"{a} binary" for a in FS.ARRAYS)))


def _assembled(tops: DataFrame, subtrees: DataFrame) -> DataFrame:
    """One row per tree of ``forests.FOREST``: the upper nodes with the finished subtrees in place of their open leaves."""
    def assemble(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        nodes = {a: x.copy() for a, x in _nodes(row).items() if a in FS.ARRAYS}
        whole, n = {a: [x] for a, x in nodes.items()}, len(nodes["left"])
        for r in right.sort_values("node").to_dict("records"):
            sub = {a: np.frombuffer(r[a], t).copy() for a, t in FS.ARRAYS.items()}
            for side in ("left", "right"):                # the subtree's root takes the node's place
                sub[side] = np.where(sub[side] >= 0, sub[side] + n - 1, -1).astype(np.int32)
            for a in FS.ARRAYS:
                nodes[a][r["node"]] = sub[a][0]
                whole[a].append(sub[a][1:])
            n += len(sub["left"]) - 1
        tree = Tree(**{a: np.concatenate(x).astype(np.int64 if FS.ARRAYS[a] is np.int32 else FS.ARRAYS[a]) for a, x in whole.items()})
        return pd.DataFrame([FS._tree_row(int(row["fit"]), row["site"], int(row["tree"]), tree)], columns=FS._FOREST_NAMES)

    return tops.groupBy("fit", "tree").cogroup(subtrees.groupBy("fit", "tree")).applyInPandas(assemble, FS.FOREST)


def grow_large(matrix: CodeMatrix, fits: list) -> DataFrame:
    """The trees of all fits, grown level by level (fit = place in the list)."""
    spark, base, level = matrix.blocks.sparkSession, scratch_path(matrix.blocks.sparkSession, "levels"), 0

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    tops = kept(_roots(matrix, fits), "tops0")
    while True:
        chosen = kept(_counts(matrix, tops).groupBy("fit", "tree", "node").applyInArrow(_choose, CHOSEN), f"chosen{level}")
        if not chosen.take(1):
            break
        level += 1
        tops = kept(_applied(tops, _thresholds(matrix, chosen)), f"tops{level}")
    return _assembled(tops, kept(_finished(matrix, tops), "subtrees"))
