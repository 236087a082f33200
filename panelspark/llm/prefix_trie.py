"""Prefix trie of conversations, with count-min screening of prefix digests.

A prefix is named by a polynomial digest of its turns modulo a 127-bit prime,
so digests of parts can be joined: a conversation may span range partitions
(the carry is one value for each partition), and a conversation that is rebuilt
from the head of another one needs no second look at its turns.

1. Narrow rows: only a digest and the length of each turn are sorted, by range
   of (conversation, turn); prefix digests follow by scanning the partitions.
2. Screening. Every prefix of every conversation is counted in a count-min
   sketch whose width follows the number of prefixes. The sketch is dealt over
   strips; tasks send packed cell counts and get back one bit for each cell
   they use. An estimate of one proves that no other conversation has the
   prefix, so its nodes are emitted where they are: the tail of a conversation
   from there on. Estimates err upwards only and decide no result.
3. Possibly shared prefixes are grouped exactly, with partial aggregates, so
   a first turn of a third of all conversations is no hot key.
4. Sums over subtrees need no walk over the trie. Every node is credited to its
   smallest conversation; a node's subtree is credited to its members, except
   for what its smallest member was credited with above the node.

A node's ends are hashed in order of their ids, as the result asks: blocks of
``ENDS`` ids are joined to text in parallel, and one task streams the blocks
of a node (a few bytes of state).

Defined results: turns are ordered by turn (null first), equal turns by their
digest; null role or text is empty; rows without a conversation id belong to
no conversation and are left out; repeated rows are turns of their own; an
empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach, tidy

HEADS, BLOCK = 6, 100                  # the head of a conversation has fewer than HEADS turns, of its block's first one
SKETCH_ROWS, LOAD = 2, 4               # cells of a sketch row for each prefix
LEAST_WIDTH = 1024
STRIPS, WIDEST = 64, 1 << 24           # strips of a sketch row at least, cells of a strip at most
SHARD = 100_000                        # prefixes in a packed row
ENDS = 1024
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.md5(b"conversation prefix").digest(), "big") % PRIME
_INVERSE = pow(BASE, -1, PRIME)
ROOT = (1).to_bytes(16, "big")


@lru_cache(maxsize=4096)
def _power(k: int) -> int:
    return pow(BASE, k, PRIME)


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _int(value: bytes) -> int:
    return int.from_bytes(value, "big")


def step(chain: int, digest: bytes) -> int:
    """Digest of a prefix with one more turn."""
    return (chain * BASE + _int(digest)) % PRIME


def parent_of(chain: int, digest: bytes) -> int:
    return (chain - _int(digest)) * _INVERSE % PRIME


def head_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def turn_rows(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv, turn, digest, chars): the narrow form of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return (conversations.where(F.col(conv_col).isNotNull())
            .select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
                    F.unhex(F.md5(named.cast("binary"))).alias("digest"), F.char_length(text).cast("long").alias("chars")))


OWN = pa.schema([("part", pa.int32()), ("conv", pa.int64()), ("depth", pa.int64()), ("chain", pa.binary()),
                 ("digest", pa.binary()), ("chars", pa.int64()), ("first", pa.bool_()), ("ends", pa.bool_())])


def own_prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, chain, digest, chars, ends): the prefix of every original turn; ``ends`` marks the last of a part."""
    spark = turns.sparkSession

    def scan(batches):
        part, conv, first, chain, depth, held = TaskContext.get().partitionId(), None, True, 0, 0, None
        for batch in batches:
            out = []
            for c, digest, chars in zip(*(batch.column(k).to_pylist() for k in ("conv", "digest", "chars"))):
                if held is not None:
                    out.append((*held, c != conv))
                if c != conv:
                    first = conv is None                      # the first may continue: its chain starts at nothing
                    conv, depth, chain = c, 0, int(not first)
                depth, chain = depth + 1, step(chain, digest)
                held = (part, c, depth, _bytes(chain), digest, chars, first)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), OWN)], schema=OWN)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held, True), OWN)], schema=OWN)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv", F.col("turn").asc_nulls_first(), "digest"]
    scanned = scratch.write(
        turns.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv", "digest", "chars").mapInArrow(
            tidy(scan), "part int, conv long, depth long, chain binary, digest binary, chars long, first boolean, ends boolean"),
        "scanned")
    # the carry into each part: of its first conversation, from the parts before (at most two rows of each part)
    edges = scanned.where("ends").groupBy("part").agg(
        F.max(F.when(F.col("first"), F.struct("conv", "depth", "chain"))).alias("first"),
        F.max(F.struct("conv", "depth", "chain", "first")).alias("last"))
    carry, open_ = {}, (None, 0, 1)
    for r in sorted(edges.collect()):
        conv, depth, chain = r["first"]
        carry[r["part"]] = before = open_[1:] if open_[0] == conv else (0, 1)
        conv, depth, chain, first = r["last"]
        if first:
            depth, chain = depth + before[0], _bytes((before[1] * _power(depth) + _int(chain)) % PRIME)
        open_ = (conv, depth, _int(chain))

    def continued(batches):
        for batch in batches:
            depths, chains = batch.column("depth").to_pylist(), batch.column("chain").to_pylist()
            parts, firsts = batch.column("part").to_pylist(), batch.column("first").to_pylist()
            for i, first in enumerate(firsts):
                if first:
                    count, chain = carry[parts[i]]
                    chains[i] = _bytes((chain * _power(depths[i]) + _int(chains[i])) % PRIME)
                    depths[i] += count
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(depths, pa.int64()), pa.array(chains, pa.binary()),
                                              *(batch.column(c) for c in ("digest", "chars", "ends"))],
                                             ["conv", "depth", "chain", "digest", "chars", "ends"])

    own = scratch.write(scanned.mapInArrow(tidy(continued), "conv long, depth long, chain binary, digest binary, chars long, "
                                                            "ends boolean"), "own")
    scratch.drop("scanned")
    return own


def rebuilt(own: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turns, h, cut, length, head): how each conversation is rebuilt.

    ``head`` lists (chain, chars) of the turns taken from the first conversation of the block, ``cut`` is the chain
    of its own turns that they replace, ``length`` the number of turns of the rebuilt conversation.
    """
    h = head_length(F.col("conv"))
    facts = (own.where((F.col("depth") < HEADS) | F.col("ends")).groupBy("conv")
             .agg(F.max("depth").alias("turns"), F.max(F.when(F.col("depth") == h, F.col("chain"))).alias("cut"),
                  F.collect_list(F.when((F.col("depth") < HEADS) & (F.col("conv") % BLOCK == 0),
                                        F.struct("depth", "chain", "chars"))).alias("start")))
    facts = facts.withColumn("h", h)
    heads = facts.where(f"conv % {BLOCK} = 0").select(
        F.col("conv").alias("base"), F.transform(F.array_sort("start"), lambda x: F.struct(x["chain"], x["chars"])).alias("start"))
    out = (facts.drop("start").withColumn("base", F.col("conv") - F.col("conv") % BLOCK).join(heads, "base", "left")
           .withColumn("head", F.slice(F.coalesce("start", F.array().cast("array<struct<chain:binary,chars:bigint>>")),
                                       F.lit(1), F.col("h"))))
    return scratch.write(out.select(
        "conv", "turns", "h", F.when(F.col("h") == 0, F.lit(ROOT)).otherwise(F.col("cut")).alias("cut"), "head",
        (F.size("head") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("length")), "rebuilt")


PACKED = ("shard long, conv binary, depth binary, chain binary, parent binary, chars binary, last binary")
_NAMES = [c.split()[0] for c in PACKED.split(", ")]


class _Pack:
    """Prefixes of one task as packed rows of ``SHARD``."""

    def __init__(self):
        self.shard, self.held = TaskContext.get().partitionId() << 32, []

    def add(self, *prefix):
        self.held.append(prefix)

    def rows(self, least: int):
        if len(self.held) >= least:
            conv, depth, chain, parent, chars, last = zip(*self.held)
            self.held = []
            data = [np.array(conv, np.int64).tobytes(), np.array(depth, np.int64).tobytes(), b"".join(chain),
                    b"".join(parent), np.array(chars, np.int64).tobytes(), np.array(last, bool).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([self.shard], pa.int64()), *(pa.array([d], pa.binary()) for d in data)],
                                             _NAMES)
            self.shard += 1


def all_prefixes(own: DataFrame, plans: DataFrame, scratch: Scratch) -> DataFrame:
    """Packed prefixes of all rebuilt conversations, the root left out: heads from the plans, tails from the own turns."""
    def heads(batches):
        pack = _Pack()
        for batch in batches:
            for conv, length, head in zip(*(batch.column(c).to_pylist() for c in ("conv", "length", "head"))):
                before = ROOT
                for d, turn in enumerate(head, 1):
                    pack.add(conv, d, turn["chain"], before, turn["chars"], d == length)
                    before = turn["chain"]
            yield from pack.rows(SHARD)
        yield from pack.rows(1)

    def tails(batches):
        pack = _Pack()
        for batch in batches:
            for conv, depth, chain, digest, chars, h, cut, length, head, start in zip(*(batch.column(c).to_pylist() for c in (
                    "conv", "depth", "chain", "digest", "chars", "h", "cut", "length", "taken", "start"))):
                new = (_int(chain) + (_int(start) - _int(cut)) * _power(depth - h)) % PRIME
                at = head + depth - h
                pack.add(conv, at, _bytes(new), _bytes(parent_of(new, digest)), chars, at == length)
            yield from pack.rows(SHARD)
        yield from pack.rows(1)

    spliced = plans.where("turns > h").select(
        "conv", "turns", "h", "cut", "length", F.size("head").cast("long").alias("taken"),
        F.coalesce(F.try_element_at("head", F.lit(-1))["chain"], F.lit(ROOT)).alias("start"))
    total = plans.agg(F.sum("turns")).first()[0] or 0
    rows = attach(own.drop("ends"), spliced, "conv", "turns", total).where("depth > h")
    out = (rows.drop("turns").mapInArrow(tidy(tails), PACKED)
           .unionByName(plans.where(F.size("head") > 0).select("conv", "length", "head").mapInArrow(tidy(heads), PACKED)))
    return scratch.write(out, "prefixes")


def _cells(chains: np.ndarray, width: int) -> list[np.ndarray]:
    """Cell of each 16-byte chain in each row of the sketch."""
    low = chains.view(np.uint64).reshape(-1, 2)
    return [((low[:, 0] * np.uint64(0x9E3779B97F4A7C15 + 2 * r) ^ (low[:, 1] >> np.uint64(7 * r))) * np.uint64(0xBF58476D1CE4E5B9)
             >> np.uint64(20)) % np.uint64(width) for r in range(SKETCH_ROWS)]


def _used_cells(chains: np.ndarray, width: int, strip: int):
    """(row, cell of each chain, distinct cells in order, [(strip key, where its cells begin and end)]) of each sketch row."""
    for row, cells in enumerate(_cells(chains, width)):
        used = np.unique(cells)
        of = (used // np.uint64(strip)).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(used)]])
        keys = row * (width // strip) + of[edges[:-1]]
        yield row, cells, used, list(zip(keys.tolist(), edges[:-1].tolist(), edges[1:].tolist()))


def possibly_shared(prefixes: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """(conv, depth, chain, parent, chars, last, shared, under_shared): prefixes with an estimate above one, of their own
    and of their parent's."""
    width = max(LEAST_WIDTH, 1 << int(total * LOAD).bit_length())
    strip = min(WIDEST, width // STRIPS)

    def chains_of(batch):
        return (np.frombuffer(batch.column(c)[0].as_py(), np.uint8).reshape(-1, 16) for c in ("chain", "parent"))

    def send(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                own, above = chains_of(batch)
                out = []
                for _, cells, used, strips in _used_cells(np.concatenate([own, above]), width, strip):
                    n = np.bincount(np.searchsorted(used, cells[:len(own)]), minlength=len(used))
                    n, place = np.minimum(n, 2).astype(np.uint8), (used % np.uint64(strip)).astype(np.uint32)
                    out += [(key, place[a:b].tobytes(), n[a:b].tobytes()) for key, a, b in strips]
                keys, places, counts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([batch.column("shard")[0].as_py()] * len(out), pa.int64()),
                     pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["strip", "shard", "cells", "n"])

    def meet(key, table):
        cells = [np.frombuffer(v, np.uint32) for v in table.column("cells").to_pylist()]
        counts = np.zeros(strip, np.uint8)
        for at, n in zip(cells, table.column("n").to_pylist()):
            counts[at] = np.minimum(counts[at] + np.frombuffer(n, np.uint8), 2)
        return pa.table({"shard": table.column("shard"), "strip": table.column("strip"),
                         "many": pa.array([np.packbits(counts[at] > 1).tobytes() for at in cells], pa.binary())})

    def screen(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                own, above = chains_of(batch)
                both = np.concatenate([own, above])
                told = {a["strip"]: a["many"] for a in batch.column("answers")[0].as_py()}
                shared = np.ones(len(both), bool)
                for _, cells, used, strips in _used_cells(both, width, strip):
                    many = np.concatenate([np.unpackbits(np.frombuffer(told[key], np.uint8), count=b - a) for key, a, b in strips])
                    shared &= many[np.searchsorted(used, cells)].astype(bool)
                n = len(own)
                shared[n:] |= (above == np.frombuffer(ROOT, np.uint8)).all(axis=1)
                conv, depth, chars = (pa.array(np.frombuffer(batch.column(c)[0].as_py(), np.int64)) for c in ("conv", "depth", "chars"))
                chain, parent = (pa.array([r.tobytes() for r in c], pa.binary()) for c in (own, above))
                last = pa.array(np.frombuffer(batch.column("last")[0].as_py(), bool))
                yield pa.RecordBatch.from_arrays(
                    [conv, depth, chain, parent, chars, last, pa.array(shared[:n]), pa.array(shared[n:])],
                    ["conv", "depth", "chain", "parent", "chars", "last", "shared", "under_shared"])

    answers = (prefixes.select("shard", "chain", "parent").mapInArrow(tidy(send), "strip long, shard long, cells binary, n binary")
               .groupBy("strip").applyInArrow(meet, "shard long, strip long, many binary")
               .groupBy("shard").agg(F.collect_list(F.struct("strip", "many")).alias("answers")))
    return scratch.write(prefixes.join(answers, "shard").mapInArrow(
        tidy(screen), "conv long, depth long, chain binary, parent binary, chars long, last boolean, shared boolean, "
                      "under_shared boolean"), "screened")


def credit_above(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(chain, above): what a node's conversation was credited with for the nodes above it.

    A running sum by (conversation, depth) over range partitions: inside a part by a window, between the parts of a
    conversation by a window over one sum for each part.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.write(nodes.select("conv_id", "depth", "chain", "saving").repartitionByRange(n, "conv_id", "depth")
                           .withColumn("part", F.spark_partition_id()), "credits")
    inside = Window.partitionBy("conv_id", "part").orderBy("depth")
    between = Window.partitionBy("conv_id").orderBy("part")
    sums = ranged.groupBy("conv_id", "part").agg(F.sum("saving").alias("whole"))
    carried = sums.select("conv_id", "part", (F.sum("whole").over(between) - F.col("whole")).alias("carried"))
    return (ranged.withColumn("running", F.sum("saving").over(inside) - F.col("saving")).join(carried, ["conv_id", "part"])
            .select("chain", (F.col("running") + F.col("carried")).alias("above")))


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """(chain, ends_sha256) of the ids (chain, conv), ascending in decimal, joined by commas."""
    blocks = (ends.groupBy("chain", F.floor(F.col("conv") / ENDS).alias("block"))
              .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids")))

    def digest(batches):
        open_, state, out = None, None, []
        for batch in batches:
            for chain, ids in zip(batch.column("chain").to_pylist(), batch.column("ids").to_pylist()):
                if chain == open_:
                    state.update(b"," + ids.encode())
                    continue
                if open_ is not None:
                    out.append((open_, state.hexdigest()))
                open_, state = chain, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["chain", "ends_sha256"])
                out = []
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_]), pa.array([state.hexdigest()])], ["chain", "ends_sha256"])

    return (blocks.repartition("chain").sortWithinPartitions("chain", "block").select("chain", "ids")
            .mapInArrow(tidy(digest), "chain binary, ends_sha256 string"))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame, **columns) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included (``COLUMNS``)."""
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    own = own_prefixes(turn_rows(conversations, **columns), scratch)
    plans = rebuilt(own, scratch)
    total = plans.agg(F.sum("length")).first()[0] or 0
    screened = possibly_shared(all_prefixes(own, plans, scratch), total, scratch)
    scratch.drop("own", "prefixes")
    nothing, zero, one = F.lit(hashlib.sha256(b"").hexdigest()), F.lit(0).cast("long"), F.lit(1).cast("long")

    single, maybe = screened.where("not shared"), screened.where("shared")
    grouped = maybe.groupBy("chain").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("depth"),
        F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.max("under_shared").alias("under_shared"))
    root = (plans.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(F.lit(ROOT).alias("chain"), "conv_id", "n_convs", zero.alias("depth"), F.lit(None).cast("binary").alias("parent"),
                    zero.alias("chars"), F.lit(False).alias("under_shared")))
    grouped = scratch.write(grouped.unionByName(root), "grouped")
    below = (grouped.where("under_shared").select("parent").unionAll(single.where("under_shared").select("parent"))
             .groupBy(F.col("parent").alias("chain")).agg(F.count(F.lit(1)).alias("n_children")))
    nodes = scratch.write(
        grouped.join(below, "chain", "left")
        .select("*", F.coalesce(F.col("n_children"), F.lit(0)).alias("children"),
                ((F.col("n_convs") - 1) * F.col("chars")).alias("saving")).drop("n_children"), "nodes")

    credits = (nodes.select(F.col("conv_id").alias("conv"), "saving", (F.col("children") == 0).cast("long").alias("leaf"))
               .where("saving > 0 or leaf > 0")
               .unionByName(single.where("last").select("conv", zero.alias("saving"), one.alias("leaf")))
               .groupBy("conv").agg(F.sum("saving").alias("saving"), F.sum("leaf").alias("leaf")))
    credits = scratch.write(credits.join(plans.select("conv", F.greatest("length", F.lit(1)).alias("weight")), "conv"), "credited")
    everything = credits.agg(F.sum("saving").alias("saved"), F.sum("leaf").alias("n_leaves")).select(
        F.lit(ROOT).alias("chain"), "saved", "n_leaves")
    sums = (attach(maybe.select("conv", "chain"), credits, "conv", "weight", total).groupBy("chain")
            .agg(F.sum("saving").alias("saved"), F.sum("leaf").alias("n_leaves")).unionByName(everything))
    ends = (maybe.where("last").select("chain", "conv")
            .unionByName(plans.where("length = 0").select(F.lit(ROOT).alias("chain"), "conv")))
    full = (nodes.join(sums, "chain").join(credit_above(nodes, scratch), "chain").join(_ends_hashes(ends), "chain", "left"))
    full = full.select("parent", "under_shared", "conv_id", "depth", "n_convs", F.col("children").alias("n_children"), "n_leaves",
                       (F.col("saved") - F.col("above")).alias("saved_tokens"),
                       F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    alone = single.select("parent", "under_shared", F.col("conv").alias("conv_id"), "depth", one.alias("n_convs"),
                          F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
                          zero.alias("saved_tokens"),
                          F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256))
                          .otherwise(nothing).alias("ends_sha256"))
    every = full.unionByName(alone)
    above = nodes.where("children > 0").select(F.col("chain").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "children")
    named = attach(every.where("under_shared"), above, "parent", "children", total)
    own_parent = F.when(F.col("parent").isNotNull(), F.col("conv_id"))
    return (named.drop("children").unionByName(every.where("not under_shared").withColumn("parent_conv_id", own_parent))
            .select(*COLUMNS))
