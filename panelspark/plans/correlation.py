"""Correlation study: matrix, target correlations, top/bottom 10, high pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import config as C
from ..operators import correlate as COR
from ..operators.ordering import as_is


def correlation_study(prepared: DataFrame, target: str = C.TARGET, features=tuple(C.C32),
                      threshold: float = C.HIGH_CORR, order_key=as_is) -> dict[str, DataFrame]:
    """All tables of the study; each is one aggregate over ``prepared`` plus small steps."""
    features = list(features)
    target_corr = COR.corr_target(prepared, target, features, order_key=order_key)
    return {
        "correlation_matrix": COR.corr_matrix(prepared, target, features),
        "target_correlations": target_corr,
        "top_bottom": COR.corr_top_bottom(target_corr, 10, order_key=order_key),
        "high_pairs": COR.corr_high_pairs(prepared, features, threshold, order_key=order_key),
    }
