"""File sources and sinks: site CSV panels, optional earlier results, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import config as C
from ..session import listing


def panel_path(base: str, period: str = "") -> str:
    suffix = f"_{period.lstrip('_')}" if period else ""
    return f"{base}/complete{suffix}"


def site_path(base: str, site: str, period: str = "") -> str:
    """Folder of one site's CSV files for a period (Hive-style site partition)."""
    return f"{panel_path(base, period)}/site={site}"


def _typed(df: DataFrame, columns=None) -> DataFrame:
    """Cast the header-named string columns by name (any column order).

    Date -> DATE, everything else -> DOUBLE; blank cells are NULL and NaN
    cells become NULL too.  ANSI casts fail on malformed values.
    """
    cols = columns or C.PANEL_INPUTS
    out = [F.col("Date").cast("date").alias("Date")]
    for c in cols:
        if c == "Date":
            continue
        v = F.col(c).cast("double")
        out.append(F.nanvl(v, F.lit(None).cast("double")).alias(c))
    return out


def scan_panel(spark: SparkSession, path: str, site: str | None = None,
               columns=None) -> DataFrame:
    """Read one site CSV (header, comma, no inference), typed by column name."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = raw.select(*_typed(raw, columns))
    if site is not None:
        df = df.select(F.lit(site).alias("site"), "*")
    return df


def scan_multi_site(spark: SparkSession, base: str, sites=None, period: str = "",
                    columns=None) -> DataFrame:
    """Read the CSVs of the given sites, by default of all, in one scan; the site comes from the file path."""
    paths = [f"{panel_path(base, period)}/*"] if sites is None else [site_path(base, s, period) for s in sites]
    raw = spark.read.option("header", True).option("inferSchema", False).csv(paths)
    site = F.regexp_extract(F.col("_metadata.file_path"), r"/site=([^/]+)/[^/]*$", 1)
    return raw.select(site.alias("site"), *_typed(raw, columns))


def scan_site_tables(spark: SparkSession, base: str, period: str = "") -> DataFrame:
    """The user's site tables below ``base``: ``{site}_complete{_period}.csv`` files or the partitioned layout.

    Column names come from the headers (every file of a run has the same
    measurements); the site comes from the file's path.
    """
    suffix = f"_{period.lstrip('_')}" if period else ""
    names = [name for name, _, _ in listing(spark, base)]
    flat = [n for n in names if n.endswith(f"_complete{suffix}.csv")]
    read = spark.read.option("header", True).option("inferSchema", False)
    raw = read.csv(flat if flat else f"{panel_path(base, period)}/*")
    rule = rf"([^/]+)_complete{suffix}\.csv$" if flat else r"/site=([^/]+)/[^/]*$"
    columns = [c for c in raw.columns if c != "site"]
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), rule, 1).alias("site"), *_typed(raw, columns))


def write_site_csvs(panel: DataFrame, base: str, period: str = "") -> str:
    """Write the panel in one pass as CSV (header, ISO dates), one folder per site."""
    cols = ["Date"] + [c for c in panel.columns if c not in ("site", "Date")]
    path = panel_path(base, period)
    panel.select("site", *cols).write.mode("overwrite").partitionBy("site").option("header", True).csv(path)
    return path


def sink_table(df: DataFrame, path: str, fmt: str = "csv", partition_by=None) -> str:
    """Write a result table (overwrite; CSV with header, or parquet)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read an earlier stage's table if it exists, else an empty typed frame."""
    try:
        if fmt == "csv":
            return spark.read.schema(schema).option("header", True).csv(path)
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
