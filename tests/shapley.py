"""Exact Shapley values by enumeration, for small trees."""

import numpy as np

from panelspark.operators.forest import TreeArrays


def brute_force_shap(x: np.ndarray, tree_list: list[TreeArrays]) -> np.ndarray:
    """Exact Shapley values by enumerating coalitions."""
    from itertools import combinations
    from math import factorial

    nf = x.shape[0]
    n_trees = len(tree_list)

    def cond_exp(tree: TreeArrays, s: set, node: int = 0) -> float:
        f = int(tree.feature[node])
        if f < 0 or tree.left[node] < 0:
            return float(tree.value[node])
        l, r = int(tree.left[node]), int(tree.right[node])
        if f in s:
            return cond_exp(tree, s, l if x[f] <= tree.threshold[node] else r)
        c = tree.cover[node]
        return (tree.cover[l] * cond_exp(tree, s, l) + tree.cover[r] * cond_exp(tree, s, r)) / c

    def value(s):
        return sum(cond_exp(t, s) for t in tree_list) / n_trees

    phi = np.zeros(nf)
    for i in range(nf):
        others = [j for j in range(nf) if j != i]
        for k in range(len(others) + 1):
            wgt = factorial(k) * factorial(nf - k - 1) / factorial(nf)
            for sub in combinations(others, k):
                s = set(sub)
                phi[i] += wgt * (value(s | {i}) - value(s))
    return phi
