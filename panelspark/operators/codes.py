"""Training matrix of order-preserving codes, built once and shared by all fits of all sites.

Each feature value of a site becomes its rank among the site's distinct values
of that feature (its code), so a fit compares small integers and a threshold is
found between neighbouring values. Up to ``MOST_CODES`` distinct values are
told apart; a feature with more is cut at as many quantiles. Rows are packed
into blocks of about ``BLOCK_ROWS`` rows: one binary column of codes
(feature x row), the targets, the folds and an id that all bag draws hash.
Eliminating a feature drops a row of that matrix; nothing is assembled again.

The dictionary travels as the block ``DICTIONARY`` of its site. Sites without
rows do not occur; rows must be complete (``prepare`` sees to it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .growth import Scale

MOST_CODES = 1 << 16
BLOCK_ROWS = 8192
DICTIONARY = -1
TEST_FOLD = -1                       # fold of rows outside the training part

BLOCKS = ("site string, block long, n long, ids binary, days binary, y binary, fold binary, codes binary, centre double, "
          "spread double, site_rows long")


@dataclass
class CodeMatrix:
    """``blocks``: the packed rows and dictionaries; ``sizes``, ``folds``, ``stamps``: one entry a site."""

    blocks: DataFrame
    features: list[str]
    sizes: dict[str, int]
    folds: dict[str, list[int]]
    stamps: dict[str, int]           # a hash of the site's rows, whatever their order


@dataclass
class SiteRows:
    """The rows of one site (or of some of its blocks) in a task."""

    ids: np.ndarray
    days: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    codes: np.ndarray        # (feature, row)
    blocks: list             # (block, rows in it)
    values: list             # value of each code, by feature
    scale: Scale
    site_rows: int


def row_id() -> Column:
    """A row's number in all bag draws: 60 bits of md5('site|Date'), the same in every engine."""
    digest = F.md5(F.concat(F.col("site"), F.lit("|"), F.col("Date").cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _dictionary(rows: DataFrame, features: list[str]) -> DataFrame:
    """(site, values): per site the sorted distinct values of each feature, packed."""
    cells = rows.select("site", F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "v"))
    distinct = cells.groupBy("site", "f", "v").agg(F.count(F.lit(1)).alias("n"))
    kinds = distinct.groupBy("site", "f").agg(F.count(F.lit(1)).alias("kinds"))
    # only a feature of more values than codes is cut; its rank among the distinct values then names the quantile
    few = (distinct.join(kinds.where(F.col("kinds") <= MOST_CODES), ["site", "f"])
           .groupBy("site", "f").agg(F.array_sort(F.collect_list("v")).alias("v")))
    steps = [i / MOST_CODES for i in range(1, MOST_CODES + 1)]
    many = kinds.where(F.col("kinds") > MOST_CODES).select("site", "f")
    cut = None
    if many.take(1):
        cut = (distinct.join(many, ["site", "f"]).groupBy("site", "f")
               .agg(F.array_sort(F.array_distinct(F.percentile_approx("v", steps, 4 * MOST_CODES))).alias("v")))
    lists = few if cut is None else few.unionByName(cut)
    return lists.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias("values"))


def code_matrix(rows: DataFrame, features, label: str) -> CodeMatrix:
    """The coded rows of all sites. ``rows``: site, Date, fold (``TEST_FOLD`` outside training), label and features."""
    spark, features = rows.sparkSession, list(features)
    base = scratch_path(spark, "codes")
    stats = rows.groupBy("site").agg(F.count(F.lit(1)).alias("site_rows"), F.avg(label).alias("centre"),
                                     F.min(label).alias("_low"), F.max(label).alias("_high"),
                                     F.sort_array(F.collect_set("fold")).alias("folds"),
                                     F.bit_xor(F.xxhash64("Date", "fold", label, *features)).alias("stamp"))
    stats = stats.withColumn("spread", F.greatest(F.col("_high") - F.col("centre"), F.col("centre") - F.col("_low"))).drop("_low", "_high")
    stats.write.parquet(f"{base}/stats")
    stats = spark.read.parquet(f"{base}/stats")
    few = {r["site"]: r for r in stats.collect()}                       # one row a site
    blocks = F.ceil(F.col("site_rows") / BLOCK_ROWS)
    day = F.unix_date("Date")
    placed = (rows.join(stats.select("site", "site_rows"), "site")
              .select("site", F.pmod(F.xxhash64("Date"), blocks).alias("block"), row_id().alias("id"),
                      day.alias("day"), F.col(label).cast("double").alias("y"), F.col("fold").cast("int").alias("fold"),
                      F.array(*[F.col(f).cast("double") for f in features]).alias("x")))

    def pack(key, table):
        order = np.argsort(table.column("day").to_numpy(), kind="stable")
        col = lambda c, t: np.ascontiguousarray(table.column(c).to_numpy()[order], t).tobytes()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        out = {"site": key[0].as_py(), "block": key[1].as_py(), "n": len(order), "ids": col("id", np.int64),
               "days": col("day", np.int32), "y": col("y", np.float64), "fold": col("fold", np.int32),
               "x": np.ascontiguousarray(x.T).tobytes()}
        return pa.Table.from_pylist([out], _PACKED)

    def encode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = np.frombuffer(row.column("x")[0].as_py()).reshape(len(features), -1)
                codes = [np.minimum(np.searchsorted(np.array(v), x[f]), len(v) - 1) for f, v in enumerate(row.column("values")[0].as_py())]
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("site", "block", "n", "ids", "days", "y", "fold")),
                     pa.array([np.array(codes, np.uint16).tobytes()], pa.binary()),
                     *(row.column(c) for c in ("centre", "spread", "site_rows"))], _NAMES)

    def dictionary(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                values = [np.array(v, float) for v in row.column("values")[0].as_py()]
                sizes = np.array([len(v) for v in values], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [row.column("site"), pa.array([DICTIONARY], pa.int64()), pa.array([0], pa.int64()),
                     *(pa.array([b], pa.binary()) for b in (sizes, b"", b"", b"", b"".join(v.tobytes() for v in values))),
                     *(row.column(c) for c in ("centre", "spread", "site_rows"))], _NAMES)

    known = _dictionary(rows, features).join(stats.drop("folds", "stamp"), "site")
    known.write.parquet(f"{base}/values")
    known = spark.read.parquet(f"{base}/values")
    packed = placed.groupBy("site", "block").applyInArrow(pack, "site string, block long, n long, ids binary, days binary, y binary, "
                                                                "fold binary, x binary")
    coded = packed.join(known, "site").mapInArrow(encode, BLOCKS)
    coded.unionByName(known.mapInArrow(dictionary, BLOCKS)).write.parquet(f"{base}/blocks")
    return CodeMatrix(spark.read.parquet(f"{base}/blocks"), features, {s: r["site_rows"] for s, r in few.items()},
                      {s: [k for k in r["folds"] if k != TEST_FOLD] for s, r in few.items()}, {s: r["stamp"] for s, r in few.items()})


_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_PACKED = pa.schema([("site", pa.string()), ("block", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in (
    "ids", "days", "y", "fold", "x"))])


def unpack(rows: list[dict]) -> SiteRows:
    """Packed blocks of one site, its dictionary among them, as arrays (blocks in order)."""
    rows = sorted(rows, key=lambda r: r["block"])
    head, body = rows[0], rows[1:]
    sizes = np.frombuffer(head["ids"], np.int64)
    values = np.split(np.frombuffer(head["codes"]), np.cumsum(sizes)[:-1])
    join = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in body] or [np.empty(0, t)])
    codes = np.concatenate([np.frombuffer(r["codes"], np.uint16).reshape(len(sizes), -1) for r in body]
                           or [np.empty((len(sizes), 0), np.uint16)], axis=1)
    return SiteRows(join("ids", np.int64), join("days", np.int32), join("y", np.float64), join("fold", np.int32), codes,
                    [(r["block"], r["n"]) for r in body], values, Scale.of(head["centre"], head["spread"], head["site_rows"]),
                    head["site_rows"])


def by_unit(batches) -> Iterator[tuple[dict, list[dict]]]:
    """(first row, packed rows) of each unit of work; rows come sorted by (unit, block)."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if held and held[0]["unit"] != row["unit"]:
                yield held[0], held
                held = []
            held.append(row)
    if held:
        yield held[0], held
