"""Near duplicates by SimHash fingerprints, found through pivot distance tables.

A document's fingerprint has a bit set where more than half of its shingles'
64-bit hashes have it set. Documents link when their fingerprints differ in at
most ``MOST_BITS`` bits; equal fingerprints are one point, and only points are
compared.

The pivot table of a point holds its Hamming distances to ``PIVOTS`` fixed
reference fingerprints, each distance kept as the sum of its parts over
groups of bits:

1. Regions. The bits are cut into ``MOST_BITS + 1`` groups. Two linked points
   have a group without differing bits, so there all their distances to the
   references are equal: a region is a group and the distances in it. A region
   of more than ``LEAF`` points is split again in the same way by the bits that
   are left, until they are few.
2. In a region the points are sorted by their whole distance to the first
   reference. By the triangle inequality linked points differ by at most
   ``MOST_BITS`` in every coordinate, so a point meets only the window of the
   points that do in the first one; pairs whose largest coordinate difference is
   more are discarded, reference by reference.
3. The pairs that survive are verified on the fingerprints themselves.

A region returns a spanning forest of its links, so copies never make pairs;
components follow by contraction. Nothing is broadcast or collected but the
references.

Defined results: null and wordless texts have the fingerprint zero, linked like
any other; a text of fewer than ``WORDS`` words is one shingle; repeated rows
are linked; a null id never names a component that has another id (a component
of null ids only has a null id); other columns are ignored by
``link_documents`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, row_key, tidy, utf8
from .components import components, spanning

WORDS, SEED, MOST_BITS = 3, 42, 2
PIVOTS = 24
LEAF = 1500                        # points of a region that are compared in one task without a further split
LEAST_BITS = 6                     # of fewer bits a region is not split any more: 2^5 points for each table row
HASHES = 1 << 16                   # shingle hashes whose bits are counted at a time
PAIRS = 1 << 20                    # pairs of a window that are held at a time
REFERENCES = np.random.default_rng(64).integers(1 << 63, size=PIVOTS, dtype=np.uint64) * np.uint64(2) + (
    np.random.default_rng(65).integers(2, size=PIVOTS, dtype=np.uint64))
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the hashes of all shingles, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    begins, ends = begins[:n], ends[min(words, len(found)) - 1:]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, HASHES):
        spans = zip(begins[at:at + HASHES].tolist(), ends[at:at + HASHES].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(row, doc_id, point): the fingerprint of every document as a signed 64-bit integer."""
    def compute(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(prints.view(np.int64))],
                                             ["row", "doc_id", "point"])

    text = utf8(F.col(text_col))
    rows = docs.select(row_key(F.col(id_col), text).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       text.alias("text"))
    return rows.mapInArrow(tidy(compute), "row binary, doc_id long, point long")


def groups_of(mask: int, most: int = MOST_BITS) -> list[int]:
    """The set bits of ``mask`` in most + 1 groups of nearly equal size, as masks."""
    bits = [i for i in range(64) if mask >> i & 1]
    k = most + 1
    return [sum(1 << b for b in bits[len(bits) * g // k:len(bits) * (g + 1) // k]) for g in range(k)]


def distances(points: np.ndarray, mask: int = _ALL) -> np.ndarray:
    """(point, reference) table: differing bits among those of ``mask``."""
    return np.bitwise_count((points[:, None] ^ REFERENCES[None, :]) & np.uint64(mask)).astype(np.uint8)


def _split(frame: DataFrame, most: int) -> DataFrame:
    """(region, point, left): each point in one region for each group of its bits that are left."""
    def split(batches):
        for batch in batches:
            region, point, left = (batch.column(c).to_numpy() for c in ("region", "point", "left"))
            out = []
            for mask in np.unique(left):
                mine = np.flatnonzero(left == mask)
                whole = int(mask) & _ALL
                for g, group in enumerate(groups_of(whole, most)):
                    table = distances(point[mine].view(np.uint64), group)
                    keys = [xxhash.xxh3_64_intdigest(row, seed=(int(r) * 3 + g) & _ALL)
                            for r, row in zip(region[mine], map(bytes, table))]
                    out.append((np.array(keys, np.uint64).view(np.int64), point[mine],
                                np.full(len(mine), np.array([whole & ~group], np.uint64).view(np.int64)[0])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["region", "point", "left"])

    return frame.mapInArrow(tidy(split), "region long, point long, left long")


def linked_pairs(points: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of distinct points that differ in at most ``most`` bits, by their pivot table."""
    table = distances(points).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_ = table[order], points[order]
    # one window of later points for each point: those whose first coordinate is at most ``most`` larger
    stop = np.searchsorted(table[:, 0], table[:, 0] + most, side="right")
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    at = 0
    while at < len(points):
        many = np.cumsum(stop[at:] - np.arange(at, len(points)) - 1)
        upto = at + max(1, int(np.searchsorted(many, PAIRS, side="right")))
        n = stop[at:upto] - np.arange(at, upto) - 1
        a = np.repeat(np.arange(at, upto), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        for k in range(1, table.shape[1]):
            near = np.abs(table[a, k] - table[b, k]) <= most
            a, b = a[near], b[near]
        real = np.bitwise_count(sorted_[a] ^ sorted_[b]) <= most
        found.append((order[a[real]], order[b[real]]))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*found))


def _join_region(most: int):
    def join(key, table):
        points = np.unique(table.column("point").to_numpy())
        a, b = linked_pairs(points.view(np.uint64), most)
        a, b = spanning(points[a], points[b])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return join


def links(points: DataFrame, scratch: Scratch, most: int = MOST_BITS) -> DataFrame:
    """(a, b): links between distinct points that connect every component."""
    spark, out, turn = points.sparkSession, None, 0
    frame = points.select(F.lit(0).cast("long").alias("region"), "point", F.lit(-1).cast("long").alias("left"))
    while True:
        frame = scratch.write(_split(frame, most), f"regions{turn}")
        sizes = frame.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        large = sizes.where((F.col("size") > LEAF)).select("region")
        splits = F.bit_count("left") >= LEAST_BITS
        hot = scratch.write(frame.where(splits).join(large, "region", "left_semi"), f"hot{turn}")
        small = frame.join(sizes, "region").where((F.col("size") <= LEAF) | ~splits).select("region", "point")
        found = scratch.write(small.groupBy("region").applyInArrow(_join_region(most), "a long, b long"), f"links{turn}")
        out = found if out is None else out.unionByName(found)
        scratch.drop(f"regions{turn}")
        if not hot.take(1):
            return out
        frame, turn = hot, turn + 1


def _name():
    """Smallest id first, null ids last, then by row hash."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row"))


def link_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
              most: int = MOST_BITS) -> DataFrame:
    """(row, doc_id, fingerprint, component_id, first): ``first`` marks one document of each component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(_fingerprints(docs, id_col, text_col, words), "prints")
    own = scratch.write(prints.groupBy("point").agg(F.count(F.lit(1)).alias("copies"), F.min(_name()).alias("least")), "points")
    labels = components(links(own, scratch, most), scratch)
    named = own.join(labels, "point", "left").withColumn("label", F.coalesce("label", "point"))
    least = named.groupBy("label").agg(F.min("least").alias("chosen"), F.count(F.lit(1)).alias("size"))
    # a component may hold a third of all points
    chosen = scratch.write(attach(named.select("point", "copies", "label"), least, "label", "size", own.count())
                           .select("point", "copies", "chosen"), "chosen")
    total = chosen.agg(F.sum("copies")).first()[0] or 0
    text = F.lower(F.lpad(F.hex("point"), 16, "0"))
    return (attach(prints, chosen, "point", "copies", total)
            .select("row", "doc_id", text.alias("fingerprint"), F.col("chosen.doc_id").alias("component_id"),
                    (F.col("row") == F.col("chosen.row")).alias("first")))


def link_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    return link_rows(docs, **options).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document of each component, with all its columns; wholly repeated rows are kept once."""
    first = link_rows(docs, id_col=id_col, text_col=text_col, **options).where("first").select("row").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("whole"), row_key(F.col(id_col), utf8(F.col(text_col))).alias("row"))
    return whole.join(first, "row").dropDuplicates(["row"]).select("whole.*")
