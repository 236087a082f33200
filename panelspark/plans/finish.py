"""Output normalisation shared by query results and their SQL twins.

Aggregates over many rows differ between engines in the last bits of a
double, so derived doubles are reported at 6 decimals (and -0.0 as 0.0).
Raw panel columns are exact in both engines and are passed through.
Rounding is spelled ``round(x * 1e6) / 1e6`` in both engines: rounding a
double to an integer is the same operation everywhere (half away from
zero), while rounding to decimal places is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECIMALS = 6
SCALE = float(10 ** DECIMALS)


def finish(df: DataFrame, keep_exact=()) -> DataFrame:
    keep = set(keep_exact)
    cols = []
    for name, typ in df.dtypes:
        if typ in ("double", "float") and name not in keep:
            cols.append((F.round(F.col(name) * F.lit(SCALE), 0) / F.lit(SCALE) + F.lit(0.0)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def r(expr: str, alias: str) -> str:
    """SQL twin of ``finish`` for one column."""
    return f"round(({expr}) * 1e{DECIMALS}) / 1e{DECIMALS} + 0e0 AS {alias}"


def rank_key(c):
    """Order key of the checked queries: values equal to 6 decimals tie (then a name decides).

    Collinear panel columns tie except for the last bit of a double, which
    differs between engines. Library operators rank by raw values.
    """
    return F.round(c * F.lit(SCALE), 0)


def rank_key_sql(expr: str) -> str:
    return f"round(({expr}) * 1e{DECIMALS})"
