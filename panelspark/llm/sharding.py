"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A 64-bit hash of the document id is mapped to one of n shards without a
ring table; adding a shard moves rows into the new shard only. The law is
``key``: id and shard count alone decide, so equal texts with different ids
are spread, and a group of copies never fills one shard.

Slots number each shard's rows 0, 1, 2, ... without sorting a shard in one
task: rows of a shard are dealt into blocks by hash, numbered inside their
block, and shifted by the running total of the blocks before.

Defined results: null text has size 8 and crc32 0; a null id is a key like
any other; repeated rows get slots of their own in any order; result columns
win over input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_OVERHEAD = 8
ROWS_PER_BLOCK = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    key = keys.astype(np.uint64).copy()
    shard, nxt = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    left = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(left):
            shard[left] = nxt[left]
            key[left] = key[left] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[left] >> np.uint64(33)).astype(np.float64) + 1.0)
            nxt[left] = ((shard[left] + 1) * step).astype(np.int64)
            left = left[nxt[left] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(key)


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple = ()) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) and the ``keep`` columns."""
    results = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "_key", "_block", "_offset")
    keep = [c for c in keep if c != id_col and c not in results]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.xxhash64(F.col(id_col))
    rows = docs.select(F.col(id_col), *keep,
                       (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
                       shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"),
                       key.alias("_key"))
    blocks = max(1, docs.count() // (shards * ROWS_PER_BLOCK))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key", "text_crc32", "size", F.lit("block")), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("shard", "_block").orderBy("_key", "text_crc32", "size")
    return (rows.withColumn("slot", F.row_number().over(inside) - F.lit(1))
            .join(offsets, ["shard", "_block"])
            .select(id_col, *keep, "size", "text_crc32", "law", "shard",
                    (F.col("slot") + F.col("_offset")).cast("long").alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write whole documents as one Parquet folder per shard, in slot order."""
    out = assign_shards(docs, shards, id_col, text_col, keep=tuple(docs.columns))
    (out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
