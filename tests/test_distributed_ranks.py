"""Ranks, trailing windows and quantiles without a whole group in one task: the same rows as the plain forms."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import attribution as A
from panelspark.operators import validate as V
from panelspark.sources import panel as P

DAY = dt.date(1995, 1, 1)


def _days(spark, sizes):
    """(site, Date, target) with the given number of days per (site, year)."""
    rows = [(s, dt.date(y, 1, 1) + dt.timedelta(d), float(d)) for (s, y), n in sizes.items() for d in range(n)]
    return spark.createDataFrame(rows, "site string, Date date, y double").repartition(6)


def test_split_takes_the_smallest_hashes(spark):
    """One stratum holds half of the rows; the test rows are those of a plain ranking."""
    df = _days(spark, {("A", 1995): 365, ("A", 1996): 40, ("A", 1997): 2, ("B", 1995): 300, ("B", 1996): 7})
    got = {(r["site"], r["Date"]) for r in V.split_keys(df, "y").where("split = 'test'").collect()}
    rank = F.row_number().over(Window.partitionBy("site", F.year("Date")).orderBy(V.row_hash()))
    ranked = {(r["site"], r["Date"]): r["rank"] for r in df.withColumn("rank", rank).collect()}
    for site, n in (("A", 407), ("B", 307)):
        assert sum(s == site for s, _ in got) == -(-n // 5)
        for year in (1995, 1996, 1997):
            mine = [ranked[k] for k in got if k[0] == site and k[1].year == year]
            assert sorted(mine) == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("bins", [4096, 3, 1])
def test_quantile_rows_equal_sorted_positions(spark, monkeypatch, bins):
    monkeypatch.setattr(V, "BINS", bins)
    rng = random.Random(2)
    rows = [("A", DAY + dt.timedelta(i), rng.choice([None, 1.5, rng.gauss(0, 1), 1e9])) for i in range(200)]
    rows += [("B", DAY + dt.timedelta(i), 3.0) for i in range(11)] + [("C", DAY, None)]
    df = spark.createDataFrame(rows, "site string, Date date, Predicted_NEE double").repartition(5)
    got = {(r["site"], r["quantile_slot"]): r["Date"] for r in V.pick_quantile_rows(df).collect()}
    want = {}
    for site in "ABC":
        mine = sorted((r for r in rows if r[0] == site), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        for slot, at in enumerate((0, len(mine) // 3, 2 * len(mine) // 3, len(mine) - 1), 1):
            want[site, slot] = mine[at][1]
    assert got == want


def _daily(spark):
    rng = random.Random(4)
    rows, day = [], 0
    for _ in range(300):
        day += rng.choice([1, 1, 1, 2, 5, 13, 14, 15, 40]) if rng.random() < 0.98 else 150
        rows.append(("A" if rng.random() < 0.9 else "B", DAY + dt.timedelta(day), *[round(rng.gauss(0, 9), 3) for _ in range(4)]))
    rows.append(("early", dt.date(1960, 5, 1), 1.0, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "site string, Date date, TA double, TS_10cm double, SWC_10cm double, precipitation_rate double")


@pytest.mark.parametrize("block_days", [14, 16, 37])
def test_time_blocks_change_no_lag(spark, monkeypatch, block_days):
    """Blocks with a halo against one block for all days, over gaps longer than a block."""
    daily = _daily(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(P, "BLOCK_DAYS", 1 << 20)
    want = rows(P.trailing(daily))
    monkeypatch.setattr(P, "BLOCK_DAYS", block_days)
    assert rows(P.trailing(daily)) == want and len(want) == daily.count()


def test_no_window_holds_a_whole_site(spark):
    plan = P.trailing(_daily(spark))._jdf.queryExecution().toString()
    windows = re.findall(r"windowspecdefinition\(site#\d+, ([a-zA-Z_]+)#", plan)
    assert windows and set(windows) == {"_block"}


def test_quantile_ranks_are_within_the_stated_error(spark):
    rng = random.Random(6)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([("A", "f", v, v) for v in values], "site string, Feature string, value double, shap double").repartition(7)
    ordered = sorted(values)
    for accuracy in (100, 10_000):
        row = A.shap_quantiles(df, accuracy=accuracy).first()
        for p in A.QUANTILES:
            rank = ordered.index(row[f"q{round(p * 100):02d}"]) + 1
            assert abs(rank - p * len(values)) <= len(values) / accuracy + 1
    assert (row["n"], row["shap_min"], row["shap_max"]) == (20_000, ordered[0], ordered[-1])


def test_density_sums_to_one(spark):
    rows = [("A", "f", float(i), float(i % 17)) for i in range(500)] + [("A", "g", 1.0, 2.0)] * 4
    out = A.shap_density(spark.createDataFrame(rows, "site string, Feature string, value double, shap double"))
    f = out.where("Feature = 'f'")
    assert f.count() == 50 and abs(f.agg(F.sum(F.col("density") * (F.col("bin_hi") - F.col("bin_lo")))).first()[0] - 1) < 1e-9
    g = {r["bin"]: r for r in out.where("Feature = 'g'").collect()}
    assert g[0]["n"] == 4 and g[0]["density"] is None and g[0]["mean_value"] == 1.0 and g[1]["n"] == 0
