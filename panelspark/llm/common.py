"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: At most this many groups can hold a thousandth of the rows each.
HOT_GROUPS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """Whole text as UTF-8 bytes; null is empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def row_key(doc_id: Column, text: Column) -> Column:
    """128-bit key of a row's id and whole text (UTF-8 bytes): rows with equal keys are repeated rows."""
    name = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    kind = F.when(doc_id.isNull(), F.lit("n")).otherwise(F.lit("i")).cast("binary")
    return F.unhex(F.md5(F.concat(kind, name, F.lit(":").cast("binary"), text)))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def tidy(work: Callable) -> Callable:
    """A batch function whose freed memory goes back to the system when its task ends.

    Python workers are kept for later tasks; without this, each keeps the
    most that any task has used.
    """
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` to cut lineage between jobs.

    Written tables outlive a lost executor; ``drop`` deletes one that no
    later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths = spark, scratch_path(spark, name), {}

    def write(self, df: DataFrame, name: str, partition_by: tuple = ()) -> DataFrame:
        path = self.paths[name] = f"{self.base}/{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Join one group row to each of its rows without putting a hot group in one task.

    ``weight`` is the group's row count. Groups of a thousandth of all rows or
    more are at most ``HOT_GROUPS``, so they are broadcast; the others meet
    their rows in an ordinary equi join.
    """
    is_hot = F.col(weight) * HOT_GROUPS >= F.lit(max(total, 1))
    hot, rest = groups.where(is_hot), groups.where(~is_hot)
    return (rows.join(F.broadcast(hot), key)
            .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)))
