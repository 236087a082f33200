"""Correlation study: Pearson matrix, target correlations, high pairs, top/bottom.

The k x k matrix is one grouped pass: the sums and the sums of outer products
of each row's values about one literal point, aggregated as one vector with
MLlib's ``Summarizer`` (a JVM aggregate that merges one buffer per task and
group). The shuffle therefore carries one buffer per task and group whatever
the data size; everything after it works on the (k x k) result. Target
correlations need only k covariances and use plain ``covar_pop``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .ordering import as_is


def _r(cov: Column, sa: Column, sb: Column) -> Column:
    # NULL (not an error under ANSI mode) when a column is constant.
    return cov / F.nullif(sa * sb, F.lit(0.0))


def corr_pairs(df: DataFrame, cols, by=("site",), include_diagonal: bool = True,
               both_orders: bool = True) -> DataFrame:
    """Long Pearson correlations (by..., feature_a, feature_b, idx_a, idx_b, r).

    r is NULL when either column is constant in the group. Eager: one job finds
    the overall means when this is called.
    """
    cols = list(cols)
    k = len(cols)
    by = list(by)
    # Moments are taken about one literal point for all groups (the overall means), so nothing is
    # joined to the rows; r does not depend on the point, which only keeps the sums well scaled.
    centre = df.agg(*[F.avg(c) for c in cols]).first()
    shifted = F.array(*[F.col(c).cast("double") - F.lit(float(m or 0.0)) for c, m in zip(cols, centre)])
    outer = F.concat(F.col("_x"), F.flatten(F.transform("_x", lambda a: F.transform("_x", lambda b: a * b))))
    tab = (df.select(*by, *cols, shifted.alias("_x")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.min(c) == F.max(c) for c in cols]).alias("_const"),
        Summarizer.sum(array_to_vector(outer)).alias("_s"))
        .select(*by, "_n", "_const", vector_to_array("_s").alias("_arr"))
        .withColumn("_sum", F.slice("_arr", 1, k)).withColumn("_arr", F.slice("_arr", k + 1, k * k)))
    names = F.array(*[F.lit(c) for c in cols])

    def moment(i, j, products):
        return products - F.element_at("_sum", i + 1) * F.element_at("_sum", j + 1) / F.col("_n")

    grid = (tab.select("*", F.posexplode("_arr").alias("_pos", "_sab"))
            .withColumns({"idx_a": (F.col("_pos") / k).cast("int"), "idx_b": (F.col("_pos") % k).cast("int")}))
    if not include_diagonal:
        grid = grid.where(F.col("idx_a") != F.col("idx_b"))
    if not both_orders:
        grid = grid.where(F.col("idx_a") <= F.col("idx_b"))
    ia, ib = F.col("idx_a"), F.col("idx_b")
    s_aa = moment(ia, ia, F.element_at("_arr", ia * (k + 1) + 1))
    s_bb = moment(ib, ib, F.element_at("_arr", ib * (k + 1) + 1))
    is_const = F.element_at("_const", F.col("idx_a") + 1) | F.element_at("_const", F.col("idx_b") + 1)
    r = F.when(is_const, F.lit(None).cast("double")).otherwise(
        moment(ia, ib, F.col("_sab")) / F.nullif(F.sqrt(s_aa * s_bb), F.lit(0.0)))
    return grid.select(*by, F.element_at(names, F.col("idx_a") + 1).alias("feature_a"),
                       F.element_at(names, F.col("idx_b") + 1).alias("feature_b"),
                       "idx_a", "idx_b", r.alias("r"))


def corr_matrix(df: DataFrame, target: str, features, by=("site",)) -> DataFrame:
    """Full matrix over target + features, long form (both orders, diagonal)."""
    return corr_pairs(df, [target] + list(features), by).select(*by, "feature_a", "feature_b", "r")


def corr_target(df: DataFrame, target: str, features, by=("site",), order_key=as_is) -> DataFrame:
    """Each feature's r with the target, ranked descending (NULLs last)."""
    cols = [target] + list(features)
    aggs = [F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(target, f).alias(f"_c{i}") for i, f in enumerate(features, start=1)]
    agg = df.groupBy(*by).agg(*aggs)
    entries = [F.struct(F.lit(f).alias("Feature"),
                        _r(F.col(f"_c{i}"), F.col("_s0"), F.col(f"_s{i}")).alias("Correlation"))
               for i, f in enumerate(features, start=1)]
    long = agg.select(*by, F.inline(F.array(*entries)))
    w = Window.partitionBy(*by).orderBy(order_key(F.col("Correlation")).desc_nulls_last(), F.col("Feature"))
    return long.withColumns({
        "rank": F.row_number().over(w),
        "sign": F.when(F.col("Correlation") > 0, F.lit("positive")).otherwise(F.lit("negative")),
    })


def corr_high_pairs(df: DataFrame, features, threshold: float = C.HIGH_CORR, by=("site",),
                    order_key=as_is) -> DataFrame:
    """Feature pairs (i < j in list order) with |r| above the threshold, strongest first."""
    pairs = corr_pairs(df, features, by, include_diagonal=False, both_orders=False)
    hi = pairs.where(F.abs("r") > F.lit(threshold))
    w = Window.partitionBy(*by).orderBy(order_key(F.abs("r")).desc(), "idx_a", "idx_b")
    return hi.withColumn("rank", F.row_number().over(w)).select(
        *by, F.col("feature_a").alias("feature_1"), F.col("feature_b").alias("feature_2"), "r", "rank")


def corr_top_bottom(target_corr: DataFrame, n: int = 10, by=("site",), order_key=as_is) -> DataFrame:
    """The n highest and n lowest target correlations, tagged, with positions."""
    up = Window.partitionBy(*by).orderBy(order_key(F.col("Correlation")).desc_nulls_last(), F.col("Feature"))
    down = Window.partitionBy(*by).orderBy(order_key(F.col("Correlation")).asc_nulls_last(), F.col("Feature").desc())
    ranked = target_corr.select(*by, "Feature", "Correlation",
                                F.row_number().over(up).alias("_up"),
                                F.row_number().over(down).alias("_down"))
    top = ranked.where(F.col("_up") <= n).select(*by, F.lit("top").alias("end"),
                                                 F.col("_up").alias("position"), "Feature", "Correlation")
    bottom = ranked.where(F.col("_down") <= n).select(*by, F.lit("bottom").alias("end"),
                                                      F.col("_down").alias("position"), "Feature", "Correlation")
    return top.unionByName(bottom)
