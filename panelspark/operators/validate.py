"""Validation splits: exact year-stratified hold-out, year folds, row samples.

A stratum is never sorted in one task: the k-th row of a group is found from a
histogram of its sort key (``BINS`` bins, one aggregate), and only rows of one bin
are ranked among each other. Other windows run over the histograms or over
tiny derived tables (sites x years).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import small_side


HASH_DIGITS = 3                      # of the hexadecimal hash: 4096 bins of nearly equal size
BINS = 4096


def _before(bins: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the group in the bins before each one."""
    w = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bins.withColumn("_before", F.sum("_in_bin").over(w) - F.col("_in_bin"))


def row_hash(seed: int = C.SEED) -> Column:
    """Seeded, engine-independent order of rows: md5('<seed>|site|Date')."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("site"), F.lit("|"), F.col("Date").cast("string")))


def split_keys(panel: DataFrame, target: str = C.TARGET, seed: int = C.SEED,
               num: int = C.TEST_FRACTION_NUM, den: int = C.TEST_FRACTION_DEN) -> DataFrame:
    """(site, Date, split) with an exact proportional test share per year.

    Per site: ``n_test = ceil(N * num / den)``; each year gets the floor of its
    share, the remaining test rows go to the years with the largest
    remainders (smaller year first on ties); inside a year the first rows in
    hash order are test.  Computed once on the rows with a target value, so
    every stage sees the same split of the same days.
    """
    keys = (panel.where(F.col(target).isNotNull() & ~F.isnan(target))
            .select("site", "Date", F.year("Date").alias("Year"), row_hash(seed).alias("_h")))
    years = keys.groupBy("site", "Year").agg(F.count("*").alias("n_y"))
    years = years.withColumn("n_y", F.when(
        F.col("n_y") < 2,
        F.raise_error(F.concat(F.lit("stratified split: fewer than 2 rows in site/year "),
                               F.col("site"), F.lit("/"), F.col("Year").cast("string"))))
        .otherwise(F.col("n_y")))
    w_site = Window.partitionBy("site")
    alloc = (years
             .withColumn("n_site", F.sum("n_y").over(w_site))
             .withColumn("n_test", F.expr(f"(n_site * {num} + {den - 1}) div {den}"))
             .withColumn("q_floor", F.expr("(n_test * n_y) div n_site"))
             .withColumn("q_rem", F.expr("(n_test * n_y) % n_site"))
             .withColumn("deficit", F.col("n_test") - F.sum("q_floor").over(w_site))
             .withColumn("rem_rank", F.row_number().over(
                 w_site.orderBy(F.col("q_rem").desc(), F.col("Year"))))
             .select("site", "Year",
                     (F.col("q_floor") + F.when(F.col("rem_rank") <= F.col("deficit"), 1).otherwise(0))
                     .alias("quota")))
    keys = keys.withColumn("_bin", F.substring("_h", 1, HASH_DIGITS))
    bins = _before(keys.groupBy("site", "Year", "_bin").agg(F.count(F.lit(1)).alias("_in_bin")), ["site", "Year"])
    left = bins.join(alloc, ["site", "Year"]).select("site", "Year", "_bin", (F.col("quota") - F.col("_before")).alias("_left"))
    w_bin = Window.partitionBy("site", "Year", "_bin").orderBy("_h")
    return (keys.withColumn("_place", F.row_number().over(w_bin)).join(left, ["site", "Year", "_bin"])
            .select("site", "Date",
                    F.when(F.col("_place") <= F.col("_left"), F.lit("test"))
                    .otherwise(F.lit("train")).alias("split")))


def split_stratified(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Attach the shared split to prepared rows (equi join on site, Date)."""
    return df.join(keys, ["site", "Date"], "inner")


def cv_group_folds(train: DataFrame) -> DataFrame:
    """One fold per distinct training year: fold = dense rank of the year - 1.

    The rank is taken on the distinct (site, Year) table and joined back, so
    no task ever holds a whole site.  Fewer than two years raises.
    """
    years = train.select("site", "Year").distinct()
    ranked = (years
              .withColumn("fold", F.dense_rank().over(Window.partitionBy("site").orderBy("Year")) - 1)
              .withColumn("_n", F.count("*").over(Window.partitionBy("site")))
              .select("site", "Year",
                      F.when(F.col("_n") < 2, F.raise_error(F.lit("need at least 2 unique years for year folds")))
                      .otherwise(F.col("fold")).cast("int").alias("fold")))
    return train.join(small_side(ranked), ["site", "Year"], "inner")


def sample_test_rows(test: DataFrame, n: int = C.SHAP_SAMPLE, seed: int = C.SEED) -> DataFrame:
    """Up to n rows per site, without replacement, in seeded hash order.

    ``row_number() <= n`` is planned as a window group limit: every map task
    keeps at most n rows per site before the shuffle.
    """
    w = Window.partitionBy("site").orderBy(row_hash(seed + 1), "Date")
    return test.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def pick_quantile_rows(df: DataFrame, score: str = "Predicted_NEE") -> DataFrame:
    """Rows at sorted positions 0, n div 3, 2n div 3 and n-1 of the score, per site.

    One output row per slot (1..4); a row filling several slots (tiny n)
    appears once per slot.  Null scores come first. The score's range per site is
    cut into equal bins; a position is that of its bin plus the place in it.
    """
    value = F.col(score)
    known = F.when(~F.isnan(value), value)
    ranges = small_side(df.groupBy("site").agg(F.min(known).alias("_low"), F.max(known).alias("_high"),
                                               F.count(F.lit(1)).alias("_n")))
    share = (value - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    bin_ = (F.when(value.isNull(), -1).when(F.isnan(value), BINS)
            .otherwise(F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0))).cast("int"))
    rows = df.join(ranges, "site").withColumn("_bin", bin_)
    bins = _before(rows.groupBy("site", "_bin").agg(F.count(F.lit(1)).alias("_in_bin")), ["site"])
    w = Window.partitionBy("site", "_bin").orderBy(value, F.col("Date"))
    ranked = (rows.withColumn("_place", F.row_number().over(w) - 1).join(bins.drop("_in_bin"), ["site", "_bin"])
              .withColumn("_pos", F.col("_before") + F.col("_place")))
    slots = F.expr("array(named_struct('slot', 1, 'p', 0), named_struct('slot', 2, 'p', _n div 3), "
                   "named_struct('slot', 3, 'p', (2 * _n) div 3), named_struct('slot', 4, 'p', _n - 1))")
    hits = F.filter(slots, lambda x: x["p"] == F.col("_pos"))
    return (ranked.withColumn("_hit", F.explode(hits))
            .select(*df.columns, F.col("_hit.slot").alias("quantile_slot")))
