"""Connected components of a link table by contraction.

Each round every point takes the smallest point among itself and its
neighbours as its label. Both ends of every link are replaced by their labels,
each task keeps a spanning forest of its links, and the next round works on the
contracted table only. A star is done after two rounds; the points are hashes,
so chains shrink by a constant factor in each round. Links never grow. No
point's links meet in one task: labels are aggregates with partial sums, and
hot points are looked up by ``attach``. Once at most ``FINISH_LINKS`` links are
left (a few megabytes, whatever the corpus), one task finishes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, tidy

FOREST_LINKS = 1_000_000               # links whose spanning forest a task keeps at a time
FINISH_LINKS = 1_000_000               # links that one task finishes (16 bytes each)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect the same points as the links (a, b): fewer than there are points."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    first, second = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[first], label[second])
        new = label.copy()
        np.minimum.at(new, label[first], low)
        np.minimum.at(new, label[second], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        new = new[label]
        if (new == label).all():
            break
        label = new
    star = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[star]], nodes[star]


def local_forest(links: DataFrame) -> DataFrame:
    """(a, b): the links of each task replaced by a spanning forest of them (no shuffle)."""
    def shrink(batches):
        held, size = [], 0

        def flush():
            a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return spanning(a, b)

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
            size += batch.num_rows
            if size > FOREST_LINKS:
                held = [flush()]
                size = len(held[0][0])
                if size > FOREST_LINKS // 2:             # mostly a forest already
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flush()], ["a", "b"])

    return links.select("a", "b").mapInArrow(tidy(shrink), "a long, b long")


def _finished(edges: DataFrame) -> DataFrame:
    """(point, label) of links that fit one task: the smallest point of each component."""
    def label(batches):
        ends = [tuple(batch.column(c).to_numpy() for c in ("a", "b")) for batch in batches]
        if ends:
            low, point = spanning(*(np.concatenate(x) for x in zip(*ends)))
            roots = np.unique(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([point, roots])), pa.array(np.concatenate([low, roots]))],
                                             ["point", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(tidy(label), "point long, label long")


def components(links: DataFrame, scratch: Scratch, name: str = "all") -> DataFrame:
    """(point, label): the same label for all points that the links (a, b) connect."""
    def kept(df: DataFrame, what: str) -> DataFrame:
        return scratch.write(df, f"{name}-{what}")

    def composed(labels: DataFrame, new: DataFrame) -> DataFrame:
        """Labels that still have links move on; the others stay."""
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        moves = (sizes.join(new.select(F.col("point").alias("label"), F.col("label").alias("next")), "label", "left")
                 .select("label", "size", F.coalesce("next", "label").alias("next")))
        return attach(labels, moves, "label", "size", labels.count()).select("point", F.col("next").alias("label"))

    edges = kept(local_forest(links.where("a <> b")), "edges-0")
    labels, turn = None, 0
    while True:
        total = edges.count()
        if total <= FINISH_LINKS:
            last = kept(_finished(edges), "finished")
            scratch.drop(f"{name}-edges-{turn}")
            return last if labels is None else kept(composed(labels, last), "labels")
        both = edges.select("a", "b").unionAll(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count(F.lit(1)).alias("degree"))
        near = kept(near.withColumnRenamed("a", "point"), f"near-{turn}")
        labels = kept(near.select("point", "label") if labels is None else composed(labels, near), f"labels-{turn}")
        for end in ("a", "b"):
            ends = near.select(F.col("point").alias(end), F.col("label").alias("next"), "degree")
            edges = attach(edges, ends, end, "degree", total).drop(end, "degree").withColumnRenamed("next", end)
        turn += 1
        edges = kept(local_forest(edges.where("a <> b").distinct()), f"edges-{turn}")
        scratch.drop(f"{name}-edges-{turn - 1}", f"{name}-near-{turn - 1}", *([f"{name}-labels-{turn - 2}"] if turn > 1 else []))
