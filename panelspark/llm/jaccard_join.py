"""Exact Jaccard self-join of word shingles as a metric-space join.

The Jaccard distance is a metric, so with r = 1 - similarity:

1. Equal sets are one point; only points are joined.
2. Isolated points. Linked sets share at least ``shared_at_least`` of their
   smallest-hash shingles (a longer prefix filter), so points that share fewer
   with all others are regions of their own. A second pass counts, over whole
   sets of the remaining points, the shingles that no other point has.
3. Voronoi regions. Of the remaining points, the pivot of each rare shingle
   (in a point's rarest-first prefix) is the point with the smallest hash; a
   point is replicated to the region of every pivot it meets there. Linked
   points share a prefix shingle, so they meet in a region.
4. In a region every point's distance d to the pivot is computed. Points with
   d <= r are linked to it. By the triangle inequality such a point can only be
   linked outside this group to points whose d is at most r larger: if there is
   none, it is settled. The pivot, too, is settled; the other points (outer
   points and the boundary points in the window) form a smaller region that is
   joined recursively: inside one task if it is small, else by rounds of many
   pivots against blocks of the region, until its points are settled or known
   to be in one component.
5. Links are pivot stars and spanning links, reduced to a spanning forest in
   each task, so a group of copies gives a linear number of rows; components
   follow by contraction of the link table (``components``).

Sets are compared by 64-bit hashes of their shingles; sets are one point, and rows
one row, where 128 bits of their digests agree.

Defined results: null and wordless texts have no shingles and are linked with
nothing; a null id never names a component that has another id (a component
of null ids only has a null id); repeated rows are linked; other columns are
ignored by ``link_documents`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, row_key, tidy, utf8
from .components import components, local_forest

WORDS, PERCENT = 5, 75
EXTRA = 0.05                       # prefix beyond the plain prefix filter, as a share of the set
FLUSH = 500_000                    # postings a map task holds
BUCKET = 1_000_000                 # postings per reduce task
LEAF = 1000                        # points of a region that is joined inside one task
BLOCK = 500                        # points of a larger region that one task compares with the round's pivots
MOST_PIVOTS = 1024                 # pivots of a round, at most an eighth of the region
KEPT_WORDS = 200_000
DIGEST = (1 << 64) - 1              # bits of a set's first digest
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    out = h[:len(h) - words + 1]
    for k in range(1, words):
        out = out * _STEP + h[k:len(h) - words + 1 + k]
    return np.unique(_mix(out))


def least_common(n, percent: int = PERCENT):
    """A linked set shares at least this many of its n shingles."""
    return -(-(n * percent) // 100)


def extra(n):
    return np.maximum(1, np.ceil(np.asarray(n) * EXTRA)).astype(np.int64)


def shared_at_least(n, percent: int = PERCENT):
    """Common shingles, in both extended prefixes, of a set of n shingles and any set linked to it."""
    return extra(least_common(n, percent))


def is_linked(inter, n, m, percent: int = PERCENT):
    return 100 * inter >= percent * (n + m - inter)


def _digest(s: np.ndarray, twins=(), mask: int = DIGEST) -> int:
    """Name of a set: its first 64-bit digest, or the second one where different sets share the first."""
    data = s.tobytes()
    first = int(np.array([xxhash.xxh3_64_intdigest(data) & mask], np.uint64).view(np.int64)[0])
    return int(np.frombuffer(xxhash.xxh3_64_digest(data, seed=1), np.int64)[0]) if first in twins else first


def _points(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(row, doc_id, n, point, check): the set size and both digests of every document's set."""
    mask = DIGEST

    def digest(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), hashes, words) for t in batch.column("text")]
            first = [_digest(s, (), mask) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(first, pa.int64()), pa.array([_digest(s, (d,), mask) for s, d in zip(sets, first)], pa.int64())],
                ["row", "doc_id", "n", "point", "check"])

    return _rows(docs, id_col, text_col).mapInArrow(tidy(digest), "row binary, doc_id long, n long, point long, check long")


def _named_points(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, words: int) -> tuple[DataFrame, frozenset]:
    """(row, doc_id, n, point), and the first digests that different sets share (a handful in 10^10 documents).

    Sets with such a digest are named by the second one, so that sets are one point only if 128 bits agree.
    """
    raw = scratch.write(_points(docs, id_col, text_col, words), "points")
    shared = (raw.where("n > 0").groupBy("point").agg(F.min("check").alias("low"), F.max("check").alias("high"))
              .where("low <> high").select("point"))
    twins = frozenset(r["point"] for r in shared.collect())
    name = F.col("point") if not twins else F.when(F.col("point").isin(list(twins)), F.col("check")).otherwise(F.col("point"))
    return raw.select("row", "doc_id", "n", name.alias("point")), twins


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = utf8(F.col(text_col))
    return docs.select(row_key(F.col(id_col), text).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       text.alias("text"))


def _bucketed(values: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions) of the values."""
    task = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    return [(int(task[p[0]]), p) for p in np.split(order, np.flatnonzero(np.diff(task[order])) + 1) if len(p)]


POSTINGS = ("bucket long, shingles binary, owners binary, points binary, many binary, credit_points binary, "
            "credits binary")
KEPT_BYTES = 6                     # of a shingle's hash in the isolation test: a clash only keeps a point longer


def _prefix_postings(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, buckets: int,
                     twins: frozenset) -> DataFrame:
    """Packed (shingle, point) postings of the extended prefixes.

    A shingle that several points of a flush have is credited to them at once and sent once,
    so a shingle of a third of all documents does not fill one bucket.
    """
    names, mask = [c.split()[0] for c in POSTINGS.split(", ")], DIGEST

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        points = np.repeat(np.array(list(held), np.int64), [len(p) for p in held.values()])
        shingles = np.concatenate(list(held.values()))
        order = np.argsort(shingles, kind="stable")
        shingles, points = shingles[order], points[order]
        first = np.concatenate([[True], shingles[1:] != shingles[:-1]])
        count = np.diff(np.append(np.flatnonzero(first), len(shingles)))
        credited, credits = np.unique(points[np.repeat(count > 1, count)], return_counts=True)
        shingles, points, many = shingles[first], points[first], count > 1
        for i, (bucket, at) in enumerate(_bucketed(shingles, buckets)):
            named, owner = np.unique(points[at], return_inverse=True)
            short = shingles[at].view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]
            row = [bucket, short.tobytes(), owner.astype(np.uint32).tobytes(), named.tobytes(),
                   np.packbits(many[at]).tobytes(), b"" if i else credited.tobytes(),
                   b"" if i else credits.astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()),
                                              *(pa.array([v], pa.binary()) for v in row[1:])], names)

    def send(batches):
        hashes, held, size = WordHashes(), {}, 0
        for batch in batches:
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), hashes, words)
                if len(s) and (point := _digest(s, twins, mask)) not in held:
                    held[point] = s[:len(s) - least_common(len(s), percent) + int(extra(len(s)))].copy()
                    size += len(held[point])
                    if size > FLUSH:
                        yield from flush(held)
                        held, size = {}, 0
        if held:
            yield from flush(held)

    return _rows(docs, id_col, text_col).select("text").mapInArrow(tidy(send), POSTINGS)


def _shared_counts(buckets: int):
    def count(key, table):
        points, shared = _credits(table)
        parts = _bucketed(points.view(np.uint64), buckets)
        return pa.table({"part": pa.array([b for b, _ in parts], pa.int64()),
                         "points": pa.array([points[at].tobytes() for _, at in parts], pa.binary()),
                         "shared": pa.array([shared[at].tobytes() for _, at in parts], pa.binary())})

    return count


def _add_counts(key, table):
    """(point, shared): sums over the packed counts of one part of the points."""
    points, shared = (np.concatenate([np.frombuffer(v, np.int64) for v in table.column(c).to_pylist()])
                      for c in ("points", "shared"))
    found, where = np.unique(points, return_inverse=True)
    return pa.table({"point": found, "shared": np.bincount(where, shared, len(found)).astype(np.int64)})


def _credits(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Points of a bucket of shingles, and how many of each one's prefix shingles another point has."""
    cols = {c: [np.frombuffer(v, t) for v in table.column(c).to_pylist()] for c, t in (
        ("shingles", np.uint8), ("owners", np.uint32), ("points", np.int64), ("many", np.uint8),
        ("credit_points", np.int64), ("credits", np.int64))}
    short = np.concatenate(cols["shingles"]).reshape(-1, KEPT_BYTES)
    shingles = np.pad(short, ((0, 0), (0, 8 - KEPT_BYTES))).view(np.uint64).ravel()
    points = np.concatenate([p[o] for p, o in zip(cols["points"], cols["owners"])])
    many = np.concatenate([np.unpackbits(m, count=len(o)).astype(bool) for m, o in zip(cols["many"], cols["owners"])])
    order = np.lexsort((points, shingles))
    shingles, points, many = shingles[order], points[order], many[order]
    fresh = np.concatenate([[True], shingles[1:] != shingles[:-1]])
    other = np.concatenate([[False], (shingles[1:] == shingles[:-1]) & (points[1:] != points[:-1])])
    run = np.cumsum(fresh) - 1
    shared = (np.bincount(run, other) + np.bincount(run, many))[run] > 0
    unique = fresh | other                                    # a copy's posting counts once
    points, shared, many = points[unique], shared[unique], many[unique]
    out = [(points[shared & ~many], 1), *zip(cols["credit_points"], cols["credits"])]
    at = np.concatenate([p for p, _ in out])
    weight = np.concatenate([np.broadcast_to(w, len(p)) for p, w in out])
    found, where = np.unique(at, return_inverse=True)
    return found, np.bincount(where, weight, len(found)).astype(np.int64)


SETS = "shard long, points binary, sizes binary, shingles binary"


def _set_shards(texts: DataFrame, words: int, twins: frozenset) -> DataFrame:
    """Whole sets of the given texts, about ``FLUSH`` shingles a row."""
    mask = DIGEST

    def pack(batches):
        hashes, number, sets, size = WordHashes(), TaskContext.get().partitionId() << 32, [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([np.array([_digest(s, twins, mask) for s in sets], np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([len(s) for s in sets], np.int64).tobytes()], pa.binary()),
                 pa.array([np.concatenate(sets).tobytes()], pa.binary())], ["shard", "points", "sizes", "shingles"])

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for text in batch.column("packed"):
                sets.append(shingle_set(unpack.decompress(text.as_py()), hashes, words))
                size += len(sets[-1])
                if size > FLUSH:
                    yield row()
                    number, sets, size = number + 1, [], 0
        if sets:
            yield row()

    return texts.select("packed").mapInArrow(tidy(pack), SETS)


def _packed(rows: DataFrame) -> DataFrame:
    """(row, packed): texts compressed for the exchange."""
    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([squeeze.compress(t.as_py()) for t in batch.column("text")], pa.binary())],
                ["row", "packed"])

    return rows.select("row", "text").mapInArrow(tidy(pack), "row binary, packed binary")


def _merge_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """An equi join by shuffle and merge: the same plan at every size (nothing here has a size bound)."""
    return left.hint("merge").join(right.hint("merge"), key)


def _document_frequencies(shards: DataFrame, buckets: int) -> DataFrame:
    """(shard, shingles, counts): each shard's shingles that several points have, with how many."""
    def send(batches):
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("shingles").to_pylist()):
                values, counts = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
                for bucket, at in _bucketed(values, buckets):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket], pa.int64()), pa.array([shard], pa.int64()),
                         pa.array([values[at].tobytes()], pa.binary()),
                         pa.array([counts[at].astype(np.int64).tobytes()], pa.binary())],
                        ["bucket", "shard", "shingles", "counts"])

    def add(key, table):
        shards_ = table.column("shard").to_pylist()
        values = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
        counts = np.concatenate([np.frombuffer(v, np.int64) for v in table.column("counts").to_pylist()])
        where = np.unique(np.concatenate(values), return_inverse=True)[1]
        total, at, out = np.bincount(where, counts).astype(np.int64)[where], 0, []
        for shard, v in zip(shards_, values):
            mine, at = total[at:at + len(v)], at + len(v)
            out.append({"shard": shard, "shingles": v[mine > 1].tobytes(), "counts": mine[mine > 1].tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int64()), ("shingles", pa.binary()), ("counts", pa.binary())]))

    return (shards.select("shard", "shingles").mapInArrow(tidy(send), "bucket long, shard long, shingles binary, counts binary")
            .groupBy("bucket").applyInArrow(add, "shard long, shingles binary, counts binary"))


def _candidates(shards: DataFrame, frequencies: DataFrame, percent: int) -> DataFrame:
    """(point, n, shingles, prefix): points whose shingles are shared enough, with their rarest-first prefix."""
    def choose(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                known = [(np.frombuffer(f["shingles"], np.uint64), np.frombuffer(f["counts"], np.int64))
                         for f in row["frequencies"] or ()]
                values = np.concatenate([v for v, _ in known] or [np.empty(0, np.uint64)])
                counts = np.concatenate([c for _, c in known] or [np.empty(0, np.int64)])
                order = np.argsort(values)
                values, counts = values[order], counts[order]
                points, sizes = (np.frombuffer(row[c], np.int64) for c in ("points", "sizes"))
                shingles, out = np.frombuffer(row["shingles"], np.uint64), []
                for point, s in zip(points, np.split(shingles, np.cumsum(sizes)[:-1])):
                    at = np.minimum(np.searchsorted(values, s), max(0, len(values) - 1))
                    shared = values[at] == s if len(values) else np.zeros(len(s), bool)
                    free = len(s) - int(shared.sum())
                    take = len(s) - least_common(len(s), percent) + 1 - free
                    if take > 0:
                        mine = s[shared]
                        rare = mine[np.lexsort((mine, counts[at[shared]]))][:take]
                        out.append((int(point), len(s), s.tobytes(), rare.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                     pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                    ["point", "n", "shingles", "prefix"])

    told = frequencies.groupBy("shard").agg(F.collect_list(F.struct("shingles", "counts")).alias("frequencies"))
    return shards.join(told, "shard", "left").mapInArrow(tidy(choose), "point long, n long, shingles binary, prefix array<long>")


def _distances(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(region, point, n, m, inter): every member's intersection with its region's pivot, the point ``region``."""
    def measure(batches):
        names = ["region", "point", "n", "m"]
        for batch in batches:
            mine, theirs = (batch.column(c).to_pylist() for c in ("shingles", "pivot_shingles"))
            inter = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                     for a, b in zip(mine, theirs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(inter, pa.int64())],
                                             [*names, "inter"])

    centre = sets.select(F.col("point").alias("region"), F.col("n").alias("m"), F.col("shingles").alias("pivot_shingles"))
    return (_merge_join(_merge_join(members, sets.select("point", "n", "shingles"), "point"), centre, "region")
            .select("region", "point", "n", "m", "shingles", "pivot_shingles")
            .mapInArrow(tidy(measure), "region long, point long, n long, m long, inter long"))


def _rest(measured: DataFrame, percent: int, total: int) -> DataFrame:
    """(region, point, fixed): what is left of each region after its pivot's round.

    ``fixed`` points of a region are known to be in one component.
    """
    radius = 1 - percent / 100
    d = measured.where("point <> region").select(
        "region", "point", F.expr(f"100 * inter >= {percent} * (n + m - inter)").alias("linked"),
        (1 - F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))).alias("d"))
    nearest = (d.groupBy("region").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("outer"), F.count(F.lit(1)).alias("weight"))
               .where("outer is not null"))
    return (attach(d, nearest, "region", "weight", total).where(F.expr(f"not linked or d + {radius} >= outer - 1e-9"))
            .select("region", "point", F.col("linked").alias("fixed")))


def _live(members: DataFrame) -> DataFrame:
    """The (written) members of regions that still have a pair to compare, with the region's size and open points."""
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"),
                                         F.sum(F.when(F.col("fixed"), 0).otherwise(1)).alias("open"))
    return attach(members, size.where("size > 1 and open > 0"), "region", "size", members.count())


def _block_round(large: DataFrame, sets: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links of this round's pivots with all points of their regions, and the pivots (region, point).

    A task holds one block of a region's points and the region's pivots; it sends back spanning links only.
    """
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    share = F.least(F.lit(float(MOST_PIVOTS)), F.ceil(F.col("size") / 8)) / F.col("open")
    place = F.pmod(F.xxhash64("point", F.lit(turn)), F.lit(1_000_000))
    first = (large.where("not fixed").groupBy("region").agg(F.min(F.struct(place.alias("place"), F.col("point"))).alias("first"))
             .select("region", "first.point", F.lit(True).alias("first")))
    chosen = (large.where("not fixed").join(first, ["region", "point"], "left")
              .where(F.col("first").isNotNull() | (place < share * 1_000_000)))
    pivots = chosen.select("region", "point")
    rows = (chosen.select("region", "point", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("pivot"))
            .unionByName(large.select("region", "point", F.pmod(F.xxhash64("point", F.lit("block")), blocks).alias("block"),
                                      F.lit(False).alias("pivot"))))

    def compare(key, table):
        is_pivot = np.array(table.column("pivot").to_pylist(), bool)
        points, data = table.column("point").to_numpy(), table.column("shingles").to_pylist()
        mine, centres = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)
        centres = centres[np.argsort(points[centres])]        # the same order, so the same stars, in every block
        if not len(mine):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets_ = [np.frombuffer(data[i], np.uint64) for i in mine]
        sizes = np.array([len(s) for s in sets_])
        values, number = np.unique(np.concatenate(sets_), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        node = np.concatenate([points[centres], points[mine]])
        group = np.arange(len(node))
        for k, i in enumerate(centres):
            own = np.frombuffer(data[i], np.uint64)
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            mark = np.zeros(len(values), bool)
            mark[at[values[at] == own]] = True
            near = np.flatnonzero((points[mine] != points[i]) & is_linked(
                _overlap(mark, number, starts, sizes, np.arange(len(mine))), len(own), sizes, percent))
            joined = np.unique(np.append(group[len(centres) + near], group[k]))
            group[np.isin(group, joined)] = joined[0]
        star = np.flatnonzero((group < len(centres)) & (node != node[group]))
        return pa.table({"a": node[group[star]], "b": node[star]})

    return _merge_join(rows, sets.select("point", "shingles"), "point").groupBy("region", "block").applyInArrow(
        compare, "a long, b long"), pivots


def _leaf_join(percent: int):
    def join(key, table):
        fixed = np.array(table.column("fixed").to_pylist(), bool)
        order = np.argsort(fixed, kind="stable")              # open points first
        points = table.column("point").to_numpy()[order]
        data = table.column("shingles").to_pylist()
        sets = [np.frombuffer(data[i], np.uint64) for i in order]
        fixed, sizes = fixed[order], np.array([len(s) for s in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        group = np.arange(len(points))
        group[fixed] = len(points)
        for i in range(int((~fixed).sum())):
            later = np.arange(i + 1, len(points))
            fits = (100 * np.minimum(sizes[i], sizes[later]) >= percent * np.maximum(sizes[i], sizes[later]))
            later = later[fits & (group[later] != group[i])]
            if not len(later):
                continue
            mark = np.zeros(number.max() + 1, bool)
            mark[number[starts[i]:starts[i] + sizes[i]]] = True
            for j in later[is_linked(_overlap(mark, number, starts, sizes, later), sizes[i], sizes[later], percent)]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
        centre = {}                                            # a star for each group, around its first point
        for i, g in enumerate(group):
            if g != len(points) or not fixed[i]:
                centre.setdefault(g, i)
        known = next(iter(np.flatnonzero(fixed)), None)        # the fixed points are linked to each other already
        links = [(int(points[centre[g]]), int(points[i])) for i, g in enumerate(group)
                 if g in centre and centre[g] != i and (not fixed[i] or i == known)]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return join


def _overlap(mark: np.ndarray, number: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Marked members of each of the given sets."""
    at = np.repeat(starts[sets] - np.concatenate([[0], np.cumsum(sizes[sets])[:-1]]), sizes[sets]) + np.arange(sizes[sets].sum())
    return np.add.reduceat(mark[number[at]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[sets])[:-1]]))


def _links(docs: DataFrame, points: DataFrame, twins: frozenset, scratch: Scratch, id_col: str, text_col: str, words: int,
           percent: int) -> DataFrame:
    """(a, b): links between points that connect every component."""
    spark = docs.sparkSession
    sizes = scratch.write(points.where("n > 0").groupBy("point").agg(F.min("row").alias("row"), F.max("n").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-int(total * (1 - percent / 100 + EXTRA)) // BUCKET))
    shared = (_prefix_postings(docs, id_col, text_col, words, percent, buckets, twins).groupBy("bucket")
              .applyInArrow(_shared_counts(buckets), "part long, points binary, shared binary")
              .groupBy("part").applyInArrow(_add_counts, "point long, shared long"))
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * percent / 100) * F.lit(EXTRA)))
    met = scratch.write(sizes.join(shared, "point").where(F.col("shared") >= need).select("row"), "met")
    texts = _merge_join(_packed(_rows(docs, id_col, text_col)), met, "row").dropDuplicates(["row"])
    shards = scratch.write(_set_shards(texts, words, twins), "shards")
    frequencies = scratch.write(_document_frequencies(shards, buckets), "frequencies")
    sets = scratch.write(_candidates(shards, frequencies, percent), "sets")
    scratch.drop("shards", "frequencies", "met")
    postings = sets.select("point", F.explode("prefix").alias("shingle"))
    centres = (postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min(
        F.struct(F.xxhash64("point").alias("place"), F.col("point").alias("pivot"))).alias("first"))
        .where("size > 1").select("shingle", F.col("first.pivot").alias("region")))
    members = scratch.write(postings.join(centres, "shingle").select("region", "point").distinct(), "members")
    measured = scratch.write(_distances(members, sets), "measured")
    near = (measured.where("point <> region").where(f"100 * inter >= {percent} * (n + m - inter)")
            .select(F.col("region").alias("a"), F.col("point").alias("b")))
    links = [scratch.write(local_forest(near), "stars")]      # a point meets as many pivots as it has rare shingles
    rest = scratch.write(_rest(measured, percent, measured.count()), "left0")
    left, turn = scratch.write(_live(rest), "rest0"), 0
    while True:
        small = (_merge_join(left.where(f"size <= {LEAF}"), sets.select("point", "shingles"), "point")
                 .select("region", "point", "fixed", "shingles"))
        links.append(scratch.write(small.groupBy("region").applyInArrow(_leaf_join(percent), "a long, b long"), f"leaf{turn}"))
        large = left.where(f"size > {LEAF}")
        if not large.take(1):
            return reduce(DataFrame.unionByName, links)
        turn += 1
        found, pivots = _block_round(large, sets, percent, turn)
        links.append(scratch.write(local_forest(found), f"block{turn}"))
        labels = components(reduce(DataFrame.unionByName, links), scratch, f"round{turn}")
        links = [labels.where("point <> label").select(F.col("label").alias("a"), F.col("point").alias("b"))]
        known = (large.select("region", "point").join(pivots, ["region", "point"], "left_anti")
                 .join(labels, "point", "left").withColumn("label", F.coalesce("label", "point")))
        main = (known.groupBy("region", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("region")
                .agg(F.max(F.struct("size", "label")).alias("main")).select("region", "main.label", F.lit(True).alias("main")))
        rest = scratch.write(known.join(main, ["region", "label"], "left").select(
            "region", "point", F.col("main").isNotNull().alias("fixed")), f"left{turn}")
        left = scratch.write(_live(rest), f"rest{turn}")


def link_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
              percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, first): ``first`` marks one document of each component."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    points, twins = _named_points(docs, scratch, id_col, text_col, words)
    labels = components(_links(docs, points, twins, scratch, id_col, text_col, words, percent), scratch)
    own = points.where("n > 0").groupBy("point").agg(F.count(F.lit(1)).alias("copies"),
                                                      F.min(_name()).alias("least"))
    named = own.join(labels, "point", "left").withColumn("label", F.coalesce("label", "point"))
    least = named.groupBy("label").agg(F.min("least").alias("chosen"))
    classes = scratch.write(named.select("point", "label", "copies").join(least, "label")
                            .select("point", "copies", "chosen"), "classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    linked = attach(points.where("n > 0"), classes, "point", "copies", total).drop("copies")
    alone = points.where("n = 0").withColumn("chosen", _name())
    return (linked.select("row", "doc_id", "n", "chosen").unionByName(alone.select("row", "doc_id", "n", "chosen"))
            .select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("chosen.doc_id").alias("component_id"),
                    (F.col("row") == F.col("chosen.row")).alias("first")))


def _name():
    """Smallest id first, null ids last, then by row hash."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row"))


def link_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    return link_rows(docs, **options).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document of each component, with all its columns; wholly repeated rows are kept once."""
    first = link_rows(docs, id_col=id_col, text_col=text_col, **options).where("first").select("row").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("whole"), row_key(F.col(id_col), utf8(F.col(text_col))).alias("row"))
    return whole.join(first, "row").dropDuplicates(["row"]).select("whole.*")
