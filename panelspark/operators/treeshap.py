"""Path-dependent tree SHAP for MLlib forests, run over DataFrame partitions.

Algorithm (Lundberg, Erion & Lee 2018, "Consistent individualized feature
attribution for tree ensembles", Algorithm 2), in the root-to-leaf path form
used for batched evaluation (Mitchell et al. 2022, "GPUTreeShap"):

* every leaf of every tree is one *path*; repeated splits on the same
  feature along a path merge into one element holding the interval the
  feature must fall in and the product of the cover ratios (the "zero
  fraction" z);
* for a row, an element's "one fraction" o is 1 if the row's value lies in
  the element's interval, else 0;
* the permutation weights of a path are built by EXTEND over its elements,
  and each element's attribution is its UNWOUND sum times (o - z) times the
  leaf value.

Paths are grouped by length and evaluated with numpy over (rows x paths)
blocks, so Python-level work is O(depth^2) per block.  The forest value is
the mean of the trees, so leaf values are divided by the number of trees.

Distribution: the path arrays (size bounded by the fitted model, which
already lives on the driver) are broadcast; rows are processed by
``mapInPandas`` in Arrow batches, partition by partition - no shuffle.  A
pass holds the paths of ``LEAVES_PER_PASS`` leaves; larger forests take
successive passes that add their contributions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .forest import TreeArrays

# Leaves whose paths are broadcast and evaluated in one pass over the rows.
LEAVES_PER_PASS = 50_000
# Target number of (row x path x element) cells per numpy block.
BLOCK_CELLS = 4_000_000


@dataclass
class PathGroup:
    """All paths with the same number of elements (root dummy included)."""

    feature: np.ndarray   # (P, L) int, column 0 is the root dummy (-1)
    lo: np.ndarray        # (P, L) lower bound (exclusive)
    hi: np.ndarray        # (P, L) upper bound (inclusive)
    z: np.ndarray         # (P, L) zero fractions
    v: np.ndarray         # (P,) leaf value / number of trees

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.lo, self.hi, self.z, self.v))


def tree_paths(tree: TreeArrays, weight: float) -> list[tuple[list, list, list, list, float]]:
    """Root-to-leaf paths of one tree with merged duplicate features."""
    out = []
    stack = [(0, {})]  # node, {feature: [lo, hi, z]}
    while stack:
        node, cond = stack.pop()
        f = int(tree.feature[node])
        if f < 0 or tree.left[node] < 0:
            feats = sorted(cond)
            out.append(([-1] + feats,
                        [-np.inf] + [cond[k][0] for k in feats],
                        [np.inf] + [cond[k][1] for k in feats],
                        [1.0] + [cond[k][2] for k in feats],
                        float(tree.value[node]) * weight))
            continue
        t = float(tree.threshold[node])
        parent_cover = float(tree.cover[node])
        for child, is_left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
            ratio = float(tree.cover[child]) / parent_cover if parent_cover > 0 else 0.0
            lo, hi, z = cond.get(f, (-np.inf, np.inf, 1.0))
            if is_left:
                hi = min(hi, t)
            else:
                lo = max(lo, t)
            nxt = dict(cond)
            nxt[f] = (lo, hi, z * ratio)
            stack.append((child, nxt))
    return out


def path_groups(paths: list) -> list[PathGroup]:
    """Paths as arrays, grouped by length."""
    by_len: dict[int, list] = {}
    for p in paths:
        by_len.setdefault(len(p[0]), []).append(p)
    return [PathGroup(feature=np.array([p[0] for p in ps], dtype=np.int64),
                      lo=np.array([p[1] for p in ps], dtype=float), hi=np.array([p[2] for p in ps], dtype=float),
                      z=np.array([p[3] for p in ps], dtype=float), v=np.array([p[4] for p in ps], dtype=float))
            for _, ps in sorted(by_len.items())]


def build_paths(trees: list[TreeArrays]) -> list[PathGroup]:
    """All paths of a small forest at once."""
    return path_groups([p for t in trees for p in tree_paths(t, 1.0 / len(trees))])


def expected_value(groups: list[PathGroup]) -> float:
    """Mean prediction under the training distribution (reach probability x value)."""
    return float(sum((g.z.prod(axis=1) * g.v).sum() for g in groups))


def _group_shap(x: np.ndarray, g: PathGroup, phi: np.ndarray, pred: np.ndarray) -> None:
    """Add the attributions of one path group for the rows in x (in place)."""
    n_rows = x.shape[0]
    P, L = g.feature.shape
    step = max(1, BLOCK_CELLS // max(1, P * L))
    l = L - 1
    by_feature = []                                            # per element: path order by feature, runs, features
    for i in range(1, L):
        order = np.argsort(g.feature[:, i], kind="stable")
        f = g.feature[order, i]
        runs = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        by_feature.append((order, runs, f[runs]))
    for r0 in range(0, n_rows, step):
        xb = x[r0:r0 + step]
        R = xb.shape[0]
        o = np.ones((R, P, L))
        if L > 1:
            xs = xb[:, g.feature[:, 1:]]                       # (R, P, L-1)
            o[:, :, 1:] = ((xs > g.lo[:, 1:]) & (xs <= g.hi[:, 1:])).astype(float)
        # prediction: the one path per tree whose conditions all hold
        pred[r0:r0 + R] += (o.prod(axis=2) * g.v).sum(axis=1)
        if L == 1:
            continue
        # EXTEND over the elements (root dummy first)
        w = np.zeros((R, P, L))
        w[:, :, 0] = 1.0
        for e in range(1, L):
            oe = o[:, :, e]
            ze = g.z[:, e]
            for i in range(e - 1, -1, -1):
                w[:, :, i + 1] += oe * w[:, :, i] * ((i + 1) / (e + 1))
                w[:, :, i] = ze * w[:, :, i] * ((e - i) / (e + 1))
        # UNWOUND sums per element
        for i in range(1, L):
            oi = o[:, :, i]
            zi = g.z[:, i]
            nxt = w[:, :, l].copy()
            tot1 = np.zeros((R, P))
            for j in range(l - 1, -1, -1):
                tmp = nxt * ((l + 1) / (j + 1))
                tot1 += tmp
                nxt = w[:, :, j] - tmp * zi * ((l - j) / (l + 1))
            safe_z = np.where(zi > 0, zi, 1.0)
            tot0 = np.zeros((R, P))
            for j in range(l - 1, -1, -1):
                tot0 += w[:, :, j] * ((l + 1) / (l - j))
            tot0 = np.where(zi > 0, tot0 / safe_z, 0.0)
            total = np.where(oi > 0, tot1, tot0)
            contrib = total * (oi - zi) * g.v                    # (R, P)
            order, runs, f = by_feature[i - 1]
            phi[r0:r0 + R, f] += np.add.reduceat(contrib[:, order], runs, axis=1)


def shap_matrix(x: np.ndarray, groups: list[PathGroup], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(SHAP values (rows x features), forest predictions) for a block of rows."""
    phi = np.zeros((x.shape[0], n_features))
    pred = np.zeros(x.shape[0])
    for g in groups:
        _group_shap(x, g, phi, pred)
    return phi, pred


def _chunks(trees: list[TreeArrays], leaves: int) -> Iterator[list[PathGroup]]:
    """The forest's paths, ``leaves`` at a time (a large tree spans several chunks)."""
    held: list = []
    for t in trees:
        held += tree_paths(t, 1.0 / len(trees))
        while len(held) >= leaves:
            yield path_groups(held[:leaves])
            held = held[leaves:]
    if held:
        yield path_groups(held)


def shap_tree(df: DataFrame, trees: list[TreeArrays], features, keep=("site", "Date"),
              leaves: int = LEAVES_PER_PASS) -> DataFrame:
    """Per-row SHAP values of a forest: keep columns + SHAP_<f> + Predicted_NEE + base_value.

    ``keep`` columns pass through the kernel, so callers get their rows back
    with attributions attached and no join.

    Additivity holds exactly: base_value + sum of SHAP = Predicted_NEE (the
    forest prediction recomputed from the same trees).
    """
    features = list(features)
    keep = list(keep)
    nf = len(features)
    sc = df.sparkSession.sparkContext
    chunks = list(_chunks(trees, leaves))
    base = sum(expected_value(c) for c in chunks)
    shap_cols = [f"SHAP_{f}" for f in features]
    in_schema = df.select(*keep).schema
    out_schema = T.StructType(list(in_schema.fields) + [T.StructField(c, T.DoubleType()) for c in shap_cols]
                              + [T.StructField("Predicted_NEE", T.DoubleType()),
                                 T.StructField("base_value", T.DoubleType())])
    extra = [f for f in features if f not in keep]
    cur = df.select(*keep, *extra)
    for k, groups in enumerate(chunks):
        bc = sc.broadcast(groups)
        first, last = k == 0, k == len(chunks) - 1

        def kernel(batches, bc=bc, first=first, last=last):
            gs = bc.value
            for pdf in batches:
                x = pdf[features].to_numpy(dtype=float)
                phi, pred = shap_matrix(x, gs, nf)
                out = pdf[keep].copy() if last else pdf[keep + extra].copy()
                for j, c in enumerate(shap_cols):
                    out[c] = phi[:, j] if first else pdf[c].to_numpy() + phi[:, j]
                out["Predicted_NEE"] = pred if first else pdf["Predicted_NEE"].to_numpy() + pred
                if last:
                    out["base_value"] = base
                yield out

        if last:
            schema = out_schema
        else:
            schema = T.StructType(list(df.select(*keep, *extra).schema.fields)
                                  + [T.StructField(c, T.DoubleType()) for c in shap_cols]
                                  + [T.StructField("Predicted_NEE", T.DoubleType())])
        cur = cur.mapInPandas(kernel, schema)
    return cur
