"""Run configuration: sites, feature lists, forest parameters, search space.

Everything a user of the original scripts edits by hand lives here as data,
so one code path serves every site and stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the original analysis (names, order, spaces).
# ---------------------------------------------------------------------------

TARGET = "NEE_U50_f"
SEASONAL = ["sin_doy", "cos_doy"]

# Stage-1 predictors of the second site (34, in the original order).
P34 = [
    "sin_doy", "cos_doy",
    "Snow_Cover_Percentage", "DSSM", "D_SNOW",
    "NDVI_nonSR_Median", "NDVI_nonSR_Max",
    "RH", "TA", "TA_min", "TA_max", "RG", "RG_min", "RG_max", "VPD_f", "precipitation_rate",
    "SWC_10cm", "TS_10cm",
    "TA_lag1d", "TA_lag3d", "TA_lag7d", "TA_lag14d",
    "TS_lag1d", "TS_lag3d", "TS_lag7d", "TS_lag14d",
    "SWC_lag1d", "SWC_lag7d", "SWC_lag3d", "SWC_lag14d",
    "P_lag1d", "P_lag3d", "P_lag7d", "P_lag14d",
]

# Stage-1 predictors of the first site (32, in the original order).
P32 = [
    "sin_doy", "cos_doy",
    "Snow_Cover_Percentage", "DSSM", "D_SNOW",
    "NDVI_nonSR_Max",
    "RH", "TA", "TA_min", "TA_max", "RG", "RG_min", "RG_max", "VPD_f", "precipitation_rate",
    "SWC_10cm", "TS_10cm",
    "TA_lag1d", "TA_lag3d", "TA_lag7d", "TA_lag14d",
    "TS_lag3d", "TS_lag7d", "TS_lag14d",
    "SWC_lag1d", "SWC_lag3d", "SWC_lag7d", "SWC_lag14d",
    "P_lag1d", "P_lag3d", "P_lag7d", "P_lag14d",
]

# Correlation-study predictors (32, in the original order).
C32 = [
    "sin_doy", "cos_doy",
    "Snow_Cover_Percentage", "DSSM", "D_SNOW",
    "NDVI_nonSR_Max",
    "RH", "TA", "TA_min", "TA_max", "RG", "RG_min", "VPD_f", "precipitation_rate",
    "SWC_10cm", "TS_10cm",
    "TA_lag1d", "TA_lag3d", "TA_lag7d", "TA_lag14d",
    "TS_lag1d", "TS_lag3d", "TS_lag7d", "TS_lag14d",
    "SWC_lag1d", "SWC_lag3d", "SWC_lag7d", "SWC_lag14d",
    "P_lag1d", "P_lag3d", "P_lag7d", "P_lag14d",
]

# Stage-2 features, both sites (12, in the original order).
S12 = [
    "sin_doy", "cos_doy", "DSSM", "NDVI_nonSR_Max", "RG_min", "precipitation_rate",
    "SWC_10cm", "TS_10cm", "TA_lag7d", "TS_lag3d", "SWC_lag14d", "P_lag7d",
]

# Raw (non-derived) input columns of a site panel; sin/cos are derived.
PANEL_INPUTS = [TARGET] + [c for c in P34 if c not in SEASONAL]

# Months kept by the field-season period and by the weekly season filter.
SEASON_MONTHS = (6, 7, 8, 9, 10)

# Random-search spaces.  randint(lo, hi) excludes hi; uniform(loc, scale) spans
# [loc, loc + scale].  None means "no depth limit".
SPACE_FIRST = {
    "n_estimators": ("randint", 100, 500),
    "max_depth": ("choice", [10, 20, 30, 40, 50, None]),
    "min_samples_split": ("randint", 2, 20),
    "min_samples_leaf": ("randint", 1, 10),
    "max_features": ("choice", ["sqrt", "log2", 0.3, 0.5, 0.7]),
    "max_samples": ("uniform", 0.6, 0.4),
}
SPACE_SECOND = {
    "n_estimators": ("randint", 100, 400),
    "max_depth": ("choice", [5, 10, 15, 20, 30]),
    "min_samples_split": ("randint", 2, 20),
    "min_samples_leaf": ("randint", 1, 10),
    "max_features": ("choice", ["sqrt", "log2", 0.3, 0.5]),
    "max_samples": ("uniform", 0.6, 0.4),
}

# Stage-1 default forests.
FOREST_FIRST = dict(n_estimators=200, max_depth=8, max_features="log2",
                    min_samples_leaf=2, min_samples_split=5)
FOREST_SECOND = dict(n_estimators=100, max_depth=None, max_features="sqrt",
                     min_samples_leaf=1, min_samples_split=2)

SEED = 42
TEST_FRACTION_NUM, TEST_FRACTION_DEN = 1, 5     # 20 % held out
OVERFIT_GAP = 0.15
SHAP_SAMPLE = 1000
TOP_N_WEEKLY = 8
TOP_N_DEPENDENCE = 4
HIGH_CORR = 0.8


@dataclass(frozen=True)
class ForestParams:
    """Forest hyper-parameters in the original vocabulary."""

    n_estimators: int = 100
    max_depth: int | None = None
    max_features: str | float = "sqrt"
    min_samples_leaf: int = 1
    min_samples_split: int = 2
    max_samples: float | None = None
    max_bins: int = 128
    seed: int = SEED

    def with_(self, **kw) -> "ForestParams":
        return replace(self, **kw)


@dataclass(frozen=True)
class PanelConfig:
    """One analysis run: which rows, which features, which model settings.

    ``sites=None`` takes every site of the data. Feature lists, forests and
    spaces are looked up by site; sites that are not listed use the entry
    under ``None``.
    """

    sites: tuple[str, ...] | None = None
    period: str = ""                       # "", "fieldseason" (months 6-10) or "GS"
    target: str = TARGET
    stage1_features: dict = field(default_factory=lambda: {"F": tuple(P32), None: tuple(P34)})
    stage2_features: tuple[str, ...] = tuple(S12)
    correlation_features: tuple[str, ...] = tuple(C32)
    forest_stage1: dict = field(default_factory=lambda: {"F": ForestParams(**FOREST_FIRST),
                                                         None: ForestParams(**FOREST_SECOND)})
    space: dict = field(default_factory=lambda: {"F": SPACE_FIRST, None: SPACE_SECOND})
    n_iter: int = 100
    oob: bool = True
    shap_sample: int | None = None         # rows per site in the attribution summaries; None: every test row
    top_n: int | None = TOP_N_WEEKLY
    parallelism: int = 8
    ledger: str | None = None              # shared folder of finished fits; None: a fresh one for each run

    def of_site(self, table: str, site: str):
        """The site's entry of ``stage1_features``, ``forest_stage1`` or ``space``."""
        entries = getattr(self, table)
        return entries[site] if site in entries else entries[None]

    def with_(self, **kw) -> "PanelConfig":
        return replace(self, **kw)
