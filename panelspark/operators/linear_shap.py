"""Path-dependent tree SHAP in time linear in the number of nodes (task-side kernel).

For a leaf whose path has the features j with zero fractions z_j and one
fractions o_j (1 if the row keeps to the path's interval of j, else 0), the
attribution of feature i is an integral of a polynomial in t,

    value * (o_i - z_i) * int_0^1 prod_{j != i} (o_j t + z_j (1 - t)) dt,

so Gauss-Legendre nodes for half the largest number of features on a path give
it exactly. At each node t the products are carried down the tree edge by edge
(a further split on a feature replaces that feature's factor), the values of
the leaves are summed upwards, and every edge adds the difference between its
factor's share and that of the feature's edge before: the sum over a path
telescopes to the leaf's attribution. No path is built.

Published forms of the idea: Yu et al. 2022, "Linear TreeShap"; Lundberg, Erion &
Lee 2018 for the attribution itself.
"""

from __future__ import annotations

import numpy as np

from .growth import Tree

CELLS = 400_000                      # (node, row) cells that are held at a time: a few megabytes for each array
_GONE, _LEAVES, _KEPT = 0, 1, 2      # the row had left the feature's interval before; leaves it here; keeps to it


class Levels:
    """The nodes of several trees, level by level (first all left children of a level, then all right ones)."""

    def __init__(self, trees: list[Tree], n_features: int):
        offset = np.cumsum([0, *(len(t.left) for t in trees)])
        whole = lambda name: np.concatenate([getattr(t, name) for t in trees])
        shift = np.repeat(offset[:-1], np.diff(offset))
        split_on, left, right = whole("feature"), whole("left"), whole("right")
        levels, parents, level, at = [], [], offset[:-1], 0
        while len(level):
            levels.append(level)
            inner = np.flatnonzero(left[level] >= 0)
            parents.append(at + inner)
            at += len(level)
            level = np.concatenate([x[level[inner]] + shift[level[inner]] for x in (left, right)])
        order = np.concatenate(levels)
        n = len(order)
        self.ends = np.cumsum([0, *map(len, levels)])
        self.inner = parents                                 # places of the nodes of each level that have children
        self.value, self.leaf, cover = whole("value")[order], left[order] < 0, whole("cover")[order].astype(float)
        split_on, code = split_on[order], whole("code")[order]
        self.feature, self.code = np.full(n, -1), np.zeros(n, np.int64)        # of the edge into the node
        self.parent, self.before, self.z, reach = np.zeros(n, np.int64), np.full(n, -1), np.ones(n), np.ones(n)
        last, widest = np.full((len(trees), n_features), -1), 0               # by feature: the lowest edge on the path
        for k, inner in enumerate(parents):
            widest = max(widest, int((last >= 0).sum(1).max()))
            here, lo, hi = inner - self.ends[k], self.ends[k + 1], self.ends[k + 1] + 2 * len(inner)
            if not len(inner):
                break
            above, last, child = np.concatenate([inner, inner]), last[np.concatenate([here, here])], np.arange(lo, hi)
            f = split_on[above]
            self.parent[lo:hi], self.feature[lo:hi], self.code[lo:hi] = above, f, code[above]
            self.before[lo:hi] = prev = last[np.arange(len(f)), f]
            ratio = cover[child] / cover[above]
            self.z[lo:hi] = ratio * np.where(prev >= 0, self.z[prev], 1.0)
            reach[lo:hi] = reach[above] * ratio
            last[np.arange(len(f)), f] = child
        self.base = float((reach * self.value)[self.leaf].sum())
        self.points = -(-widest // 2)
        edges = np.arange(len(trees), n)
        self.by_feature = edges[np.argsort(self.feature[edges], kind="stable")]

    def tables(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Factor that replaces the one before, and share of an edge, by state and node, at the point t."""
        z, prev = self.z, np.where(self.before >= 0, self.z[self.before], 1.0)
        old = t + (1 - t) * prev
        ratio = np.concatenate([z / prev, (1 - t) * z / old, (t + (1 - t) * z) / old])
        share = np.concatenate([np.zeros(len(z)), -1 / (1 - t) - (1 - prev) / old, (1 - z) / (t + (1 - t) * z) - (1 - prev) / old])
        return ratio, share


def shap_codes(trees: list[Tree], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(attributions (feature x row), predictions, base value), each summed over the trees."""
    p, n = codes.shape
    phi, pred = np.zeros((p, n)), np.zeros(n)
    if not trees:
        return phi, pred, 0.0
    lv = Levels(trees, p)
    points, weights = np.polynomial.legendre.leggauss(max(1, lv.points))
    tables = [(r, s * w / 2) for w, (r, s) in zip(weights, map(lv.tables, (points + 1) / 2))]
    step = max(8, CELLS // len(lv.value))
    for at in range(0, n, step):
        _add_block(lv, tables, codes[:, at:at + step], phi[:, at:at + step], pred[at:at + step])
    return phi, pred, lv.base


def _add_block(lv: Levels, tables: list, codes: np.ndarray, phi: np.ndarray, pred: np.ndarray) -> None:
    n, rows = len(lv.value), codes.shape[1]
    state = np.full((n, rows), _KEPT, np.int64)
    reached = np.ones((n, rows), bool)
    spans = list(zip(lv.ends[1:-1], lv.ends[2:]))                 # of the levels below the roots
    for lo, hi in spans:
        here = codes[lv.feature[lo:hi]] <= lv.code[lo:hi, None]
        here[(hi - lo) // 2:] ^= True                         # right children
        before = lv.before[lo:hi]
        kept_before = (state[before] == _KEPT) | (before < 0)[:, None]
        state[lo:hi] = kept_before * (1 + here)               # gone, leaves, kept
        reached[lo:hi] = reached[lv.parent[lo:hi]] & here
    pred += lv.value[lv.leaf] @ reached[lv.leaf]
    if not len(lv.by_feature):
        return
    state *= n
    state += np.arange(n)[:, None]                            # place in the tables
    total, product, factor = np.zeros((n, rows)), np.empty((n, rows)), np.empty((n, rows))
    roots = lv.ends[1]
    for ratio, share in tables:
        np.take(ratio, state, out=factor, mode="clip")
        product[:roots] = 1.0
        for lo, hi in spans:
            np.multiply(product[lv.parent[lo:hi]], factor[lo:hi], out=product[lo:hi])
        product *= lv.value[:, None]                          # leaves; the inner nodes are sums
        for k in range(len(spans) - 1, -1, -1):
            lo, hi = spans[k]
            middle = lo + (hi - lo) // 2
            product[lv.inner[k]] = product[lo:middle] + product[middle:hi]
        np.take(share, state, out=factor, mode="clip")
        factor *= product
        total += factor
    order = lv.by_feature
    starts = np.flatnonzero(np.concatenate([[True], np.diff(lv.feature[order]) > 0]))
    phi[lv.feature[order][starts]] += np.add.reduceat(total[order], starts, axis=0)
