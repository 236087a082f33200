"""The panel build on a growing input: more tasks, not larger ones."""

import pytest
from pyspark.sql import functions as F

from panelspark import session as SE
from panelspark.plans import frames


def test_panel_build_has_more_tasks_not_larger_ones(spark, tmp_path, monkeypatch):
    """A larger input gets more shuffle partitions; the build's settings end with it; its rows are the plan's."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before, used = [spark.conf.get(k) for k in keys], []
    with pytest.raises(RuntimeError), SE.bounded_tasks(spark, 64 << 30):
        assert int(spark.conf.get(keys[0])) == 4 * (64 << 30) // SE.TASK_BYTES and spark.conf.get(keys[1]) == str(SE.TASK_BYTES)
        raise RuntimeError
    assert [spark.conf.get(k) for k in keys] == before
    day = lambda i: F.expr(f"timestamp '2001-01-01 00:00:00' + make_interval(0, 0, 0, cast({i} as int))")
    spark.range(400).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"),
        (F.col("id") * 1.5).alias("o_totalprice"), day("id % 40").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1600).select(
        (F.col("id") % 400).alias("l_orderkey"), (F.col("id") % 17).alias("l_suppkey"), (F.col("id") % 50).cast("double").alias("l_quantity"),
        (F.col("id") * 2.0).alias("l_extendedprice"), (F.col("id") % 11 / 100).alias("l_discount"), (F.col("id") % 9 / 100).alias("l_tax"),
        F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    real = frames.bounded_tasks
    monkeypatch.setattr(frames, "bounded_tasks", lambda s, n: used.append(n) or real(s, n))
    monkeypatch.setattr(SE, "TASK_BYTES", 1 << 12)
    built = sorted(frames.panel(spark, str(tmp_path)).collect())
    assert len(used) == 1 and used[0] > 0 and [spark.conf.get(k) for k in keys] == before
    assert built == sorted(frames.panel(spark, str(tmp_path), materialise=False).collect()) and len(built) == 40
