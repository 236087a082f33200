"""Split and fold invariants on the derived panel."""

from pyspark.sql import functions as F

from panelspark.operators import validate as V
from panelspark.plans.frames import panel, prepared
from tests.conftest import SF_CHECK


def test_split_is_exact_and_disjoint(spark):
    keys = V.split_keys(panel(spark, SF_CHECK))
    per_site = {r["site"]: (r["n"], r["n_test"]) for r in keys.groupBy("site").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("n_test")).collect()}
    for site, (n, n_test) in per_site.items():
        assert n_test == -(-n // 5)                     # ceil(20 %)
    assert keys.select("site", "Date").distinct().count() == keys.count()


def test_split_is_proportional_per_year(spark):
    keys = V.split_keys(panel(spark, SF_CHECK)).withColumn("Year", F.year("Date"))
    rows = keys.groupBy("site", "Year").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("t")).collect()
    tot = {}
    for r in rows:
        tot.setdefault(r["site"], [0, 0])
        tot[r["site"]][0] += r["n"]
        tot[r["site"]][1] += r["t"]
    for r in rows:
        n_site, t_site = tot[r["site"]]
        share = t_site * r["n"] / n_site
        assert abs(r["t"] - share) < 1.0 + 1e-9


def test_split_is_deterministic(spark):
    a = V.split_keys(panel(spark, SF_CHECK)).where("split = 'test'").orderBy("site", "Date").collect()
    b = V.split_keys(panel(spark, SF_CHECK)).where("split = 'test'").orderBy("site", "Date").collect()
    assert a == b


def test_folds_one_per_year(spark):
    train = prepared(spark, SF_CHECK).where("split = 'train'")
    folds = V.cv_group_folds(train)
    assert folds.count() == train.count()
    per_site = folds.groupBy("site").agg(F.countDistinct("Year").alias("y"), F.countDistinct("fold").alias("f"),
                                         F.min("fold").alias("lo"), F.max("fold").alias("hi")).collect()
    for r in per_site:
        assert r["y"] == r["f"] and r["lo"] == 0 and r["hi"] == r["y"] - 1
    assert folds.groupBy("site", "fold").agg(F.countDistinct("Year").alias("n")).where("n != 1").count() == 0


def test_sample_is_bounded_and_unique(spark):
    test = prepared(spark, SF_CHECK).where("split = 'test'")
    s = V.sample_test_rows(test, n=50)
    counts = {r["site"]: r["count"] for r in s.groupBy("site").count().collect()}
    assert all(c == 50 for c in counts.values())
    assert s.select("site", "Date").distinct().count() == s.count()
