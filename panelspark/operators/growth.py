"""Growing many regression trees at once on order-preserving codes (task-side kernels).

All trees of a unit grow together, one level at a time. A (tree, row) pair with
a bag count above zero is an *element*; elements are kept in the order of their
nodes, so a node is a run. For each candidate feature the elements are sorted
by (node, code) once and all splits of all nodes are scored by running sums.

Targets are fixed-point integers, so sums do not depend on the order in which
rows are added or on how they are dealt over tasks: a forest is a function of
its rows, parameters and seed alone. Every random choice (bag counts, candidate
features) comes from a hash of the seed, the tree, the row or the node's path.

Split rule: among the candidate features the largest decrease of the squared
error; then the smaller feature, then the smaller threshold. Thresholds lie
half-way between neighbouring values that occur in the node. If no candidate
can split a node, the next candidates are tried. Sizes (``min_leaf``,
``min_split``) count different rows of the bag.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

TARGET_BITS = 62                     # of a node's sum of fixed-point targets
CODE_BITS = 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
UNLIMITED = 1 << 30


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (a published 64-bit mixer)."""
    x = np.atleast_1d(np.asarray(x, np.uint64))             # scalars would warn of the intended overflow
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_keys(seed: int, trees: np.ndarray) -> np.ndarray:
    return mix((np.asarray(trees, np.uint64) + np.uint64(1)) * _GOLDEN + mix(seed & 0xFFFFFFFFFFFFFFFF))


def poisson_steps(lam: float) -> np.ndarray:
    """Cumulative Poisson probabilities, as far as 53 bits tell them apart."""
    p, total, out, k = math.exp(-lam), 0.0, [], 0
    while total < 1 - 2.0 ** -53 and k < 64:
        total += p
        out.append(total)
        k += 1
        p *= lam / k
    return np.array(out)


def bag_counts(ids: np.ndarray, keys: np.ndarray, lam: float) -> np.ndarray:
    """(tree, row) bag counts: Poisson draws from a hash of the tree's key and the row's id."""
    u = (mix(ids.view(np.uint64)[None, :] ^ keys[:, None]) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(poisson_steps(lam), u.ravel(), side="right").reshape(u.shape).astype(np.int64)


@dataclass(frozen=True)
class Scale:
    """Fixed-point form of the targets: y = centre + q * unit."""

    centre: float
    unit: float

    @classmethod
    def of(cls, centre: float, spread: float, rows: int) -> "Scale":
        """``spread``: the largest distance from the centre; ``rows``: a bound on the rows of a node (64 draws each)."""
        bits = TARGET_BITS - max(1, int(rows)).bit_length() - 6
        return cls(centre, max(spread, 1e-300) / 2.0 ** min(50, bits))

    def encode(self, y: np.ndarray) -> np.ndarray:
        return np.rint((y - self.centre) / self.unit).astype(np.int64)


@dataclass
class Tree:
    """One tree as flat arrays; node 0 is the root, children follow their parents."""

    feature: np.ndarray      # index among the matrix' features, -1 at leaves
    code: np.ndarray         # codes up to this one go left
    threshold: np.ndarray    # values up to this one go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray        # mean target of the node's bag
    cover: np.ndarray        # its draws
    rows: np.ndarray         # its different rows
    gain: np.ndarray         # decrease of the mean squared error
    key: np.ndarray          # hash of the path, which names the node in every task

    def depth(self) -> int:
        level, deep = np.array([0]), -1
        while len(level):
            inner = level[self.left[level] >= 0]
            level, deep = np.concatenate([self.left[inner], self.right[inner]]), deep + 1
        return deep

    def importances(self, n_features: int) -> np.ndarray:
        """Gain x draws by feature, summing to 1 (zero for a single leaf)."""
        split = self.left >= 0
        own = np.bincount(self.feature[split], self.gain[split] * self.cover[split], n_features)
        return own / own.sum() if own.sum() > 0 else own


def predict_codes(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """Node value of each column of ``codes`` (feature x row)."""
    n, flat = codes.shape[1], np.ascontiguousarray(codes).ravel()
    inner = tree.left >= 0
    # leaves point to themselves; where a node's row of codes starts; children as pairs (right, left)
    begins, limit = np.where(inner, tree.feature, 0) * n, tree.code
    self_ = np.arange(len(inner))
    children = np.stack([np.where(inner, tree.right, self_), np.where(inner, tree.left, self_)], 1).ravel()
    node, row, at = np.zeros(n, np.int64), np.arange(n), None
    while True:
        here = node if at is None else node.take(at)
        live = np.flatnonzero(inner.take(here))
        if not len(live):
            return tree.value.take(node)
        if len(live) < len(here):
            at, here, row = live if at is None else at.take(live), here.take(live), row.take(live)
        go_left = flat.take(begins.take(here) + row) <= limit.take(here)
        moved = children.take(2 * here + go_left)
        if at is None:
            node = moved
        else:
            node[at] = moved


def child_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(keys * _GOLDEN + np.uint64(1)), mix(keys * _GOLDEN + np.uint64(2))


def candidate_order(keys: np.ndarray, features: np.ndarray) -> np.ndarray:
    """(node, position): the order in which each node tries the features."""
    return features[np.argsort(mix(keys[:, None] + (features.astype(np.uint64) + np.uint64(1)) * _GOLDEN), axis=1)]


class _Best:
    """The best split found so far of each node."""

    def __init__(self, n: int):
        self.score, self.feature = np.full(n, -np.inf), np.full(n, -1, np.int64)
        self.code, self.after = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def offer(self, node, score, feature, code, after) -> None:
        better = (score > self.score[node]) | ((score == self.score[node]) & (feature < self.feature[node]))
        node = node[better]
        for mine, new in ((self.score, score), (self.feature, feature), (self.code, code), (self.after, after)):
            mine[node] = new[better]


class _Runs:
    """Elements of some nodes, run by run, with what is the same for every feature."""

    def __init__(self, nodes, row, w, wy, size, total_w, total_wy, min_leaf: int):
        self.nodes, self.row, self.w, self.wy, self.total_w, self.total_wy = nodes, row, w, wy, total_w, total_wy
        self.size = size
        n = len(row)
        self.bits = np.uint64(max(1, int(n - 1).bit_length()))
        self.run = np.repeat(np.arange(len(nodes)), size)
        place = np.arange(n)
        self.base = (self.run.astype(np.uint64) << (self.bits + np.uint64(CODE_BITS))) | place.astype(np.uint64)
        self.start = np.cumsum(size) - size
        first, last = self.start + (min_leaf - 1), self.start + size - min_leaf
        self.allowed = (place >= np.repeat(first, size)) & (place < np.repeat(last, size))
        self.low = (np.uint64(1) << self.bits) - np.uint64(1)

    def offer_splits(self, best: _Best, feature: np.ndarray, flat: np.ndarray, n_rows: int) -> None:
        """Score every split of the nodes by one feature each (``flat``: the codes, feature by feature)."""
        key = flat.take(np.repeat(feature * n_rows, self.size) + self.row).astype(np.uint64)
        key <<= self.bits
        key |= self.base
        key.sort()
        element = (key & self.low).view(np.int64)
        key >>= self.bits                                              # (run, code)
        splits = np.flatnonzero((key[1:] != key[:-1]) & self.allowed[:-1])
        if not len(splits):
            return
        at = self.run.take(splits)
        sum_w, sum_wy = np.cumsum(self.w.take(element)), np.cumsum(self.wy.take(element))
        # running sums before each run
        before = self.start - 1
        before_w, before_wy = np.where(before >= 0, sum_w.take(before), 0), np.where(before >= 0, sum_wy.take(before), 0)
        left_w, left_wy = sum_w.take(splits) - before_w.take(at), sum_wy.take(splits) - before_wy.take(at)
        right_w, right_wy = self.total_w.take(at) - left_w, self.total_wy.take(at) - left_wy
        score, other = left_wy.astype(float), right_wy.astype(float)
        score *= score
        score /= left_w
        other *= other
        other /= right_w
        score += other
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        top = np.maximum.reduceat(score, heads)
        is_top = np.flatnonzero(score == np.repeat(top, np.diff(np.append(heads, len(at)))))
        first = is_top[np.concatenate([[True], at[is_top][1:] != at[is_top][:-1]])]
        where, low = at[first], np.uint64((1 << CODE_BITS) - 1)
        best.offer(self.nodes[where], score[first], feature[where], (key[splits[first]] & low).astype(np.int64),
                   (key[splits[first] + 1] & low).astype(np.int64))


def best_splits(codes, row, w, wy, size, total_w, total_wy, order: np.ndarray, mtry: int, min_leaf: int) -> _Best:
    """Best split of each run of elements; candidates beyond ``mtry`` only where none of those before splits."""
    best = _Best(len(size))
    flat, n_rows = np.ascontiguousarray(codes).ravel(), codes.shape[1]
    for at in range(0, order.shape[1], mtry):
        nodes = np.flatnonzero(best.feature < 0)
        if not len(nodes):
            break
        inside = slice(None) if len(nodes) == len(size) else np.repeat(best.feature < 0, size)
        runs = _Runs(nodes, row[inside], w[inside], wy[inside], size[nodes], total_w[nodes], total_wy[nodes], min_leaf)
        for k in range(at, min(at + mtry, order.shape[1])):
            runs.offer_splits(best, order[nodes, k], flat, n_rows)
    return best


def midpoints(values: tuple[np.ndarray, np.ndarray], feature, code, after) -> tuple[np.ndarray, np.ndarray]:
    """(threshold, last code that goes left) of splits between two codes of a feature.

    ``values``: the features' values of each code in a row, and where each feature's begin.
    """
    every, starts = values
    begins = starts.take(feature)
    low, high = every.take(begins + code), every.take(begins + after)
    mid = low / 2 + high / 2
    mid = np.where((mid >= high) | (mid < low), low, mid)
    # the last code whose value is at most mid lies in [code, after): bisection of all splits at once
    last, above = code.astype(np.int64), after.astype(np.int64)
    while (above - last > 1).any():
        middle = (last + above) // 2
        up = every.take(begins + middle) <= mid
        last, above = np.where(up, middle, last), np.where(up, above, middle)
    return mid, last


def grow(codes: np.ndarray, values: list[np.ndarray], q: np.ndarray, bags: np.ndarray, keys: np.ndarray, features,
         mtry: int, max_depth: int | None, min_leaf: int, min_split: int, scale: Scale, depth: int = 0) -> list[Tree]:
    """One tree for each row of ``bags``; ``keys`` name the trees' roots (at the given depth).

    codes: (feature, row) order-preserving codes; values: each feature's value of a code; q: fixed-point targets.
    """
    features, limit = np.array(sorted(features), np.int64), UNLIMITED if max_depth is None else int(max_depth)
    smallest = max(int(min_split), 2 * int(min_leaf))
    codes = np.ascontiguousarray(codes)
    flat, n_rows = codes.ravel(), codes.shape[1]
    in_a_row = np.concatenate(values), np.cumsum([0, *map(len, values)])[:-1]
    drawn = np.flatnonzero(bags)
    w, (tree, row) = bags.ravel().take(drawn), np.divmod(drawn, max(1, n_rows))
    wy, size = w * q.take(row), np.bincount(tree, minlength=len(bags))
    owner, node_keys = np.arange(len(bags)), keys.astype(np.uint64)    # nodes of the level: tree and key
    parent, side = np.full(len(bags), -1), np.zeros(len(bags), np.int64)
    made, count = [], 0
    while len(owner):
        start = np.cumsum(size) - size
        some, none = np.flatnonzero(size > 0), np.zeros(len(size), np.int64)
        sums = lambda x, f=np.add: none.copy() if not len(some) else _put(none, some, f.reduceat(x, start[some]))
        total_w, total_wy, targets = sums(w), sums(wy), q.take(row)
        mixed = sums(targets, np.maximum) > sums(targets, np.minimum)
        level = {"tree": owner, "parent": parent, "side": side, "key": node_keys, "cover": total_w, "rows": size,
                 "value": scale.centre + scale.unit * (total_wy / np.maximum(total_w, 1)), "feature": np.full(len(owner), -1, np.int64),
                 "code": none.copy(), "threshold": np.zeros(len(owner)), "gain": np.zeros(len(owner))}
        made.append(level)
        open_ = np.flatnonzero((size >= smallest) & mixed) if depth < limit else none[:0]
        is_open = np.zeros(len(size), bool)
        is_open[open_] = True
        inside = np.repeat(is_open, size)
        row, w, wy, size = row[inside], w[inside], wy[inside], size[open_]
        best = best_splits(codes, row, w, wy, size, total_w[open_], total_wy[open_], candidate_order(node_keys[open_], features),
                           mtry, min_leaf)
        found = best.feature >= 0
        split, inside = open_[found], np.repeat(found, size)
        row, w, wy, size = row[inside], w[inside], wy[inside], size[found]
        feature = best.feature[found]
        threshold, code = midpoints(in_a_row, feature, best.code[found], best.after[found])
        level["feature"][split], level["code"][split], level["threshold"][split] = feature, code, threshold
        base = total_wy[split].astype(float) ** 2 / total_w[split]
        level["gain"][split] = np.maximum(best.score[found] - base, 0) / total_w[split] * scale.unit ** 2
        # elements move to their child's run: a stable partition of each run
        run = np.repeat(np.arange(len(split)), size)
        go_left = flat.take(np.repeat(feature * n_rows, size) + row) <= np.repeat(code, size)
        n_left = np.bincount(run, go_left, len(split)).astype(np.int64)
        bits = max(1, len(run).bit_length())
        order = (2 * run + ~go_left) << bits | np.arange(len(run))
        order.sort()
        order &= (1 << bits) - 1
        row, w, wy = row.take(order), w.take(order), wy.take(order)
        size = np.stack([n_left, size - n_left], 1).ravel()
        owner, node_keys = np.repeat(owner[split], 2), np.stack(child_keys(node_keys[split]), 1).ravel()
        parent, side = np.repeat(count + split, 2), np.tile([0, 1], len(split))
        count, depth = count + len(level["tree"]), depth + 1
    return _trees(made, len(bags))


def _put(into: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = into.astype(values.dtype)
    out[at] = values
    return out


def _trees(levels: list[dict], n: int) -> list[Tree]:
    """Nodes of all levels, dealt to their trees."""
    if not n:
        return []
    whole = {k: np.concatenate([level[k] for level in levels]) for k in levels[0]}
    order = np.argsort(whole["tree"], kind="stable")
    sizes = np.bincount(whole["tree"], minlength=n)
    local = np.empty(len(order), np.int64)
    local[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.full(len(order), -1, np.int64), np.full(len(order), -1, np.int64)
    for side, child in ((0, left), (1, right)):
        at = np.flatnonzero((whole["parent"] >= 0) & (whole["side"] == side))
        child[whole["parent"][at]] = local[at]
    names = ("feature", "code", "threshold", "value", "cover", "rows", "gain", "key")
    parts = [dict(zip((*names, "left", "right"), a)) for a in zip(*(
        np.split(x[order], np.cumsum(sizes)[:-1]) for x in (*(whole[k] for k in names), left, right)))]
    return [Tree(**p) for p in parts]
