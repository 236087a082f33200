"""End-to-end runs that write every result table (the scripts' workflow).

    python -m panelspark.plans.run stage1 --sf /root/testdata/sf0.01 --out /shared/out
    python -m panelspark.plans.run stage2 --sf ... --out ...      (compares with stage 1 if present)
    python -m panelspark.plans.run weekly --sf ... --out ...      (reads stage-2 full predictions)
    python -m panelspark.plans.run correlation --sf ... --out ...
    python -m panelspark.plans.run stage1 --input /shared/sites --out ...   (own site tables, any site names)

Tables are written per site under ``<out>/<site>/<stage>/<table>`` as CSV
(header) or parquet; row-level tables are written by Spark tasks in
parallel, never collected.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators import validate as V
from ..operators.prepare import prepare, scan_by_site_period
from ..session import cut_lineage
from ..sources.files import read_optional, scan_site_tables, sink_table
from .correlation import correlation_study
from .frames import panel
from .stages import site_names, stage1, stage2, stage_comparison
from .weekly import observed_predicted_series, require_calendar, weekly_tables

METRICS_SCHEMA = T.StructType([T.StructField("site", T.StringType()), T.StructField("Metric", T.StringType()),
                               T.StructField("Training", T.DoubleType()), T.StructField("Test", T.DoubleType())])


def write_tables(tables: dict, base: str, fmt: str = "csv") -> list[str]:
    out = []
    for name, df in tables.items():
        if isinstance(df, DataFrame):
            out.append(sink_table(df, f"{base}/{name}", fmt))
    return out


def load_panel(spark: SparkSession, cfg: C.PanelConfig, sf_dir: str | None = None, input_dir: str | None = None):
    """The all-site panel: the user's site tables below ``input_dir``, else derived from the given tables."""
    if input_dir is None:
        return panel(spark, sf_dir, cfg.sites)
    df = scan_site_tables(spark, input_dir, cfg.period)
    return df if cfg.sites is None else df.where(F.col("site").isin(*cfg.sites))


def run_stage1(spark: SparkSession, cfg: C.PanelConfig, pan: DataFrame, out: str, fmt: str = "csv"):
    tables = stage1(spark, pan, V.split_keys(pan, cfg.target), cfg)
    for site, res in tables.items():
        write_tables(res, f"{out}/{site}/stage1", fmt)
    return {site: res["selected"] for site, res in tables.items()}


def run_stage2(spark: SparkSession, cfg: C.PanelConfig, pan: DataFrame, out: str, fmt: str = "csv"):
    tables = stage2(spark, pan, V.split_keys(pan, cfg.target), cfg)
    for site, res in tables.items():
        write_tables({k: v for k, v in res.items() if k != "scored"}, f"{out}/{site}/stage2", fmt)
        s1 = read_optional(spark, f"{out}/{site}/stage1/metrics", METRICS_SCHEMA, fmt)
        n1 = read_optional(spark, f"{out}/{site}/stage1/feature_selection_results",
                           T.StructType([T.StructField("Feature", T.StringType()),
                                         T.StructField("Selected", T.BooleanType()),
                                         T.StructField("Ranking", T.IntegerType())]), fmt)
        n_sel = n1.where(F.col("Selected")).count()
        cmp = stage_comparison(s1.withColumn("site", F.lit(site)), res["metrics"], n_sel or None, len(cfg.stage2_features))
        sink_table(cmp, f"{out}/{site}/stage2/stage_comparison", fmt)
    return list(tables)


def run_weekly(spark: SparkSession, cfg: C.PanelConfig, sites, out: str, fmt: str = "csv"):
    """Weekly calendar over every site's stage-2 full predictions (one multi-site plan)."""
    feats = list(cfg.stage2_features)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    path = f"{out}/*/stage2/full_dataset_predictions_shap_values"
    df = reader.csv(path) if fmt == "csv" else reader.parquet(path)
    site = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/stage2/", 1))
    values = ["Observed_NEE", "Predicted_NEE"] + [f"SHAP_{f}" for f in feats]
    full = df.select(site.alias("site"), F.col("Date").cast("date").alias("Date"),
                     *[F.col(c).cast("double").alias(c) for c in values]).where(F.col("site").isin(list(sites)))
    for label, n in (("all", None), (f"top{cfg.top_n}", cfg.top_n)):
        t = weekly_tables(full, feats, sites, n)
        require_calendar(t["calendar"])
        write_tables(t, f"{out}/weekly/{label}", fmt)
    sink_table(observed_predicted_series(full), f"{out}/weekly/series", fmt)


def run_correlation(spark: SparkSession, cfg: C.PanelConfig, pan: DataFrame, out: str, fmt: str = "csv"):
    feats = list(cfg.correlation_features)
    rows = prepare(scan_by_site_period(pan, period=cfg.period), feats, cfg.target)
    write_tables(correlation_study(cut_lineage(rows.select("site", cfg.target, *feats)), cfg.target, feats),
                 f"{out}/correlation", fmt)


def main(argv=None):
    ap = argparse.ArgumentParser(prog="panelspark")
    ap.add_argument("what", choices=["stage1", "stage2", "weekly", "correlation"])
    ap.add_argument("--sf", default="/root/testdata/sf0.01", help="folder of orders and lineitem")
    ap.add_argument("--input", help="folder of the user's site tables ({site}_complete{_period}.csv, or "
                                    "complete{_period}/site={site}/*.csv)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--period", default="")
    ap.add_argument("--sites", nargs="*", help="default: every site of the data")
    ap.add_argument("--target", default=C.TARGET)
    ap.add_argument("--n-iter", type=int, default=100)
    ap.add_argument("--ledger", help="shared folder of finished fits; a restarted run repeats only open ones "
                                     "(default: <out>/ledger)")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    a = ap.parse_args(argv)
    from ..session import get_session
    spark = get_session()
    cfg = C.PanelConfig(period=a.period, sites=tuple(a.sites) if a.sites else None, target=a.target, n_iter=a.n_iter,
                        ledger=a.ledger or f"{a.out}/ledger")
    pan = load_panel(spark, cfg, a.sf, a.input)
    if a.what == "stage1":
        run_stage1(spark, cfg, pan, a.out, a.format)
    elif a.what == "stage2":
        run_stage2(spark, cfg, pan, a.out, a.format)
    elif a.what == "weekly":
        run_weekly(spark, cfg, site_names(pan, cfg), a.out, a.format)
    else:
        run_correlation(spark, cfg, pan, a.out, a.format)


if __name__ == "__main__":
    main()
