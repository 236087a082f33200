"""Exact deduplication by skew-safe combining (DataFrame functions only).

Rows are combined three times, and the grouping key holds the full content
every time: in each map task (Spark's partial aggregate), per salt, and over
the salts. A hot text therefore reaches the last step as one row per salt.

Membership needs no further shuffle of texts: after the last step the number
of different contents of each digest is known. Where it is one, equal digests
have been proven to be equal contents and rows join on the digest alone;
digests with several contents join on digest and content.

Defined results: null text is the empty text; a row of the winning id is
kept, so wholly repeated rows (same id, same text) are all marked kept and
``unique`` returns one of them; a group whose ids are all null has a null
keep_id and its rows are kept; other columns are ignored by ``mark_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach

SALTS = 16


def _content(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("content"),
                       F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = _content(docs, id_col, text_col)
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
              .groupBy("text_sha256", "salt", "content")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    groups = salted.groupBy("text_sha256", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = scratch.write(
        groups.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"),
                                          F.sum("group_size").alias("group_size")), "groups")
    total, clashing = by_digest.agg(F.sum("group_size"), F.max("contents")).first()
    proven = by_digest.where("contents = 1").drop("contents")
    out = attach(rows.select("doc_id", "text_sha256"), proven, "text_sha256", "group_size", total or 0)
    if (clashing or 1) > 1:
        several = by_digest.where("contents > 1").select("text_sha256")
        out = out.unionByName(rows.join(groups.join(several, "text_sha256", "left_semi"), ["text_sha256", "content"])
                              .drop("content"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One (id, text) row per different text, by the same combining."""
    rows = _content(docs, id_col, text_col)
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
              .groupBy("text_sha256", "salt", "content").agg(F.max("doc_id").alias("doc_id")))
    return (salted.groupBy("text_sha256", "content").agg(F.max("doc_id").alias("doc_id"))
            .select(F.col("doc_id").alias(id_col), F.col("content").alias(text_col)))
