"""Repeated-substring removal by suffixes at anchors, refined symbol by symbol.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere is
removed. Sorting every suffix of the corpus is avoided in two steps:

* Anchors. Each possible start is represented by the position of the smallest
  64-byte hash among the ``SPAN`` bytes that follow it. Equal strings have
  equal anchors at equal offsets, so only suffixes at anchors are looked at
  (about one in 128), and two equal strings share at least ``NEAR`` bytes to
  the right of their anchors.
* Meta-symbols. An anchored suffix is compared as four symbols (64-bit hashes
  of its next 72, 72, 128 and 128 bytes), and by the hash of the 256 bytes
  before the anchor.

Each shard (about ``SHARD_BYTES`` of whole documents) groups its own anchored
suffixes once and collapses equal ones. Merge tasks, one per range of hashed
first symbols, group the shards' entries in five rounds: round h splits the
intervals that are still shared by their h-th symbol, so the round in which two
entries part is their common prefix in symbols. This is a refinement of hash
groups: no Burrows-Wheeler transform is built, a task sorts the symbols of its
entries anew in each round, and the shards' own order is not used. (An interleave
of the shards' transforms refined byte by byte takes as many rounds over the whole
corpus as the common prefix is long, here 400.) Intervals that stay shared after
two rounds (``NEAR`` bytes) may hold repeats:

* equal over all ``LENGTH`` bytes and the 256 bytes before: every start between
  anchor - 256 and anchor is repeated, nothing is left to check;
* otherwise the interval's starts are compared by the hash of their whole
  ``LENGTH`` bytes, in a second exchange of (hash, shard) lists.

A shard sends one entry per interval at most (intervals that already differ
inside a shard send their key only, combined before the exchange), so a
passage that fills a third of all documents does not fill a merge task.
Equality is decided on 64-bit hashes of bytes.

Defined results: null text is empty; texts under ``LENGTH`` bytes keep all
their bytes; repeated rows are separate documents (and so repeat each other);
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy, utf8

LENGTH, SPAN, GRAM = 400, 256, 64
SYMBOL_BYTES = (72, 72, 128, 128)
NEAR = 144                                   # two symbols; LENGTH - SPAN + 1 bytes are shared at least
SHARD_BYTES = 4 << 20
CHUNK = 1 << 19
MERGE_BYTES = 32 << 20                       # bytes of text per merge task
COVER, ENUMERATE = 1, 2

_RNG = np.random.default_rng(400)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _levels(block: np.ndarray, top: int) -> list[np.ndarray]:
    """Hashes of the 2**k bytes from each position, k = 0 .. top."""
    out = [_BYTE[block]]
    for k in range(top):
        step = 1 << k
        out.append(out[-1][:-step] * _power(step) + out[-1][step:])
    return out


def _at(levels: list[np.ndarray], positions: np.ndarray, length: int) -> np.ndarray:
    total, at, left = np.zeros(len(positions), np.uint64), positions, length
    for k in range(len(levels) - 1, -1, -1):
        if left >> k & 1:
            total = total * _power(1 << k) + levels[k][at]
            at, left = at + (1 << k), left - (1 << k)
    return _mix(total)


def hash_strings(text: np.ndarray, wanted: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """64-bit hashes of the strings at ascending positions, for each (positions, length)."""
    out = [np.empty(len(p), np.uint64) for p, _ in wanted]
    padded = np.concatenate([text, np.zeros(2 * SPAN + LENGTH, np.uint8)])
    for base in range(0, len(text) + LENGTH, CHUNK):
        cuts = [np.searchsorted(p, (base, base + CHUNK)) for p, _ in wanted]
        if all(a == b for a, b in cuts):
            continue
        levels = _levels(padded[base:base + CHUNK + LENGTH + SPAN], 8)
        for o, (p, length), (a, b) in zip(out, wanted, cuts):
            o[a:b] = _at(levels, p[a:b] - base, length)
    return out


def anchors(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) over documents that begin at ``starts`` (with the end appended)."""
    found = [[], [], []]
    padded = np.concatenate([text, np.zeros(SPAN + GRAM, np.uint8)])
    first, last = starts[:-1], starts[1:] - LENGTH            # inclusive range of starts per document
    for base in range(0, len(text), CHUNK):
        end = min(base + CHUNK, len(text))
        inside = (first < end) & (last >= base) & (last >= first)
        if not inside.any():
            continue
        grams = _levels(padded[base:end + SPAN + GRAM], 6)[6]
        place = np.arange(len(grams), dtype=np.uint64)
        key = (grams * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF00000000) | place
        step = 1
        while step < SPAN:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        change = np.zeros(end - base + 1, np.int8)
        np.add.at(change, np.maximum(first[inside] - base, 0), 1)
        np.add.at(change, np.minimum(last[inside] + 1, end) - base, -1)
        at = np.flatnonzero(np.cumsum(change[:-1]))
        smallest = (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((np.diff(smallest) != 0) | (np.diff(at) != 1)) + 1
        begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        for part, values in zip(found, (smallest[begin], at[begin], at[stop])):
            part.append(values + base)
    if not found[0]:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in found)


SHARD = ("shard long, doc_ids array<long>, starts binary, text binary, anchors binary, firsts binary, lasts binary, "
         "classes binary, flags binary, tables binary, uses binary")
SHARD_ARROW = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                         *[(c.split()[0], pa.binary()) for c in SHARD.split(", ")[2:]]])


def _refine(group: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Interval numbers after one more symbol; only intervals that are still shared are split by it."""
    shared = np.bincount(group)[group] > 1
    return _groups(np.column_stack([group, np.where(shared, symbol, 0)]))


def _verdict(near: np.ndarray, whole: np.ndarray, sure: np.ndarray, uses: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Flags of the entries: COVER (every start is repeated) and ENUMERATE (compare the starts).

    ``near``: interval shared over NEAR bytes; ``whole``: also over LENGTH bytes with one Burrows-Wheeler symbol;
    ``sure``: the entry has both in full; ``mixed``: a shard has several ``whole`` intervals under this one.
    """
    total = np.bincount(near, uses)
    kinds = np.bincount(near[np.unique(whole, return_index=True)[1]], minlength=len(total))
    mixed_near = np.bincount(near, mixed, minlength=len(total)) > 0
    same = np.bincount(whole, uses)[whole]
    first = np.zeros(len(near), bool)
    first[np.unique(whole, return_index=True)[1]] = True
    cover = sure & (same >= 2)
    alone = (kinds[near] == 1) & ~mixed_near[near]
    compare = (total[near] >= 2) & ~(alone & cover) & (~cover | first)
    return cover * COVER + compare * ENUMERATE


def _shard_batch(number: int, doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    joined = b"".join(texts)
    text = np.frombuffer(joined, np.uint8)
    anchor, first, last = anchors(text, starts)
    anchor, run = np.unique(anchor, return_index=True)        # a chunk border may cut one anchor's starts in two
    first, last = first[run], np.concatenate([last[run[1:] - 1], last[-1:]]) if len(run) else last
    doc = np.searchsorted(starts, anchor, side="right") - 1
    before, after = starts[doc], starts[doc + 1]
    at = [anchor + sum(SYMBOL_BYTES[:i]) for i in range(4)]
    hashed = hash_strings(text, [*zip(at, SYMBOL_BYTES), (np.maximum(anchor - SPAN, 0), SPAN)])
    table = np.stack(hashed, axis=1).view(np.int64).reshape(-1, 5)
    for i in (2, 3):
        table[at[i] + SYMBOL_BYTES[i] > after, i] = 0         # the document ends before this symbol
    table[anchor - SPAN < before, 4] = 0
    near = _groups(table[:, :2])
    whole = _groups(np.column_stack([near, table[:, 2:]]))
    sure = (table[:, 2:] != 0).all(axis=1)
    ones = np.ones(len(anchor), np.int64)
    flags = _verdict(near, whole, sure, ones, np.zeros(len(anchor), bool))
    entry = np.unique(near, return_index=True)[1]
    kinds = np.bincount(near[np.unique(whole, return_index=True)[1]], minlength=len(entry))
    entries = table[entry]
    entries[kinds > 1, 2:] = 0
    uses = np.bincount(near, minlength=len(entry)) * np.where(kinds > 1, -1, 1)     # negative: mixed in this shard
    values = [[number], [doc_ids], [starts.tobytes()], [zstandard.ZstdCompressor(level=1).compress(joined)],
              [anchor.tobytes()], [first.tobytes()], [last.tobytes()], [near.astype(np.int64).tobytes()],
              [flags.astype(np.int8).tobytes()], [entries.tobytes()], [uses.astype(np.int64).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, SHARD_ARROW)], schema=SHARD_ARROW)


def _groups(columns: np.ndarray) -> np.ndarray:
    """Interval number of each row in the sorted order of all columns."""
    if not len(columns):
        return np.empty(0, np.int64)
    order = np.lexsort(columns.T[::-1])
    rows = columns[order]
    number = np.concatenate([[0], np.cumsum((rows[1:] != rows[:-1]).any(axis=1))])
    out = np.empty(len(columns), np.int64)
    out[order] = number
    return out


def build_shards(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, doc_ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                doc_ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= SHARD_BYTES:
                    yield _shard_batch(number, doc_ids, texts)
                    number, doc_ids, texts, size = number + 1, [], [], 0
        if doc_ids:
            yield _shard_batch(number, doc_ids, texts)

    return (docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("text"))
            .mapInArrow(tidy(build), SHARD))


ENTRY = "shard long, class long, s1 long, s2 long, s3 long, s4 long, bwt long, uses long"


def shard_entries(shards: DataFrame) -> DataFrame:
    """The shards' sorted suffix tables, one row per interval over NEAR bytes."""
    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                table = np.frombuffer(row["tables"], np.int64).reshape(-1, 5)
                cols = [np.full(len(table), row["shard"]), np.arange(len(table)), *table.T,
                        np.frombuffer(row["uses"], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols],
                                                 [c.split()[0] for c in ENTRY.split(", ")])

    return shards.select("shard", "tables", "uses").mapInArrow(tidy(unpack), ENTRY)


def merge_entries(entries: DataFrame, tasks: int) -> DataFrame:
    """(shard, class, flag) of the intervals that several shards share."""
    mixed = (entries.where("uses < 0").select("s1", "s2").distinct()
             .selectExpr("-1L as shard", "-1L as class", "s1", "s2", "0L as s3", "0L as s4", "0L as bwt", "-2L as uses"))
    rows = entries.where("uses > 0").unionByName(mixed).withColumn(
        "task", F.pmod(F.xxhash64("s1"), F.lit(tasks)))

    def merge(key, table):
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        group = np.zeros(table.num_rows, np.int64)
        for h, name in enumerate(("s1", "s2", "s3", "s4", "bwt")):
            group = _refine(group, col[name])
            if h == 1:
                near = group
        sure = (col["s3"] != 0) & (col["s4"] != 0) & (col["bwt"] != 0)
        flags = _verdict(near, group, sure, np.abs(col["uses"]), col["uses"] < 0)
        keep = (flags > 0) & (col["shard"] >= 0)
        return pa.table({"shard": col["shard"][keep], "class": col["class"][keep], "flag": flags[keep].astype(np.int64)})

    return rows.groupBy("task").applyInArrow(merge, "shard long, class long, flag long")


def _flags(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, covered anchors, anchors whose starts are compared) of a shard row."""
    near, flags = np.frombuffer(row["classes"], np.int64), np.frombuffer(row["flags"], np.int8).astype(np.int64)
    uses = np.frombuffer(row["uses"], np.int64)
    told = np.zeros(len(uses), np.int64)
    for v in row["verdicts"] or ():
        told[v["class"]] |= v["flag"]
    one_kind = uses[near] > 0
    cover = (flags & COVER > 0) | (one_kind & (told[near] & COVER > 0))
    first = np.zeros(len(near), bool)
    first[np.unique(near, return_index=True)[1]] = True
    compare = (flags & ENUMERATE > 0) | (one_kind & (told[near] & ENUMERATE > 0) & (~cover | first))
    return near, cover, compare


def _starts(row: dict, compare: np.ndarray) -> np.ndarray:
    first, last = (np.frombuffer(row[c], np.int64)[compare] for c in ("firsts", "lasts"))
    count = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _text(row: dict) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)


def _start_hashes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covered anchors, compared starts, hash of the LENGTH bytes at each of them)."""
    _, cover, compare = _flags(row)
    starts = np.sort(_starts(row, compare))
    if not len(starts):
        return cover, starts, np.empty(0, np.uint64)
    return cover, starts, hash_strings(_text(row), [(starts, LENGTH)])[0]


def repeated_starts(shards: DataFrame, tasks: int) -> DataFrame:
    """(shard, hashes): per shard the hashes of compared starts that occur more than once anywhere."""
    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                hashes, n = np.unique(_start_hashes(row)[2], return_counts=True)
                task = (hashes % np.uint64(tasks)).astype(np.int64)
                order = np.argsort(task, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(task[order])) + 1) if len(order) else ():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(task[part[0]])]), pa.array([row["shard"]]),
                         pa.array([hashes[part].tobytes()], pa.binary()),
                         pa.array([(n[part] > 1).tobytes()], pa.binary())], ["task", "shard", "hashes", "twice"])

    def meet(key, table):
        rows, out = table.select(["shard", "hashes", "twice"]).to_pylist(), []
        parts = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        twice = np.concatenate([np.frombuffer(r["twice"], bool) for r in rows])
        values, where = np.unique(np.concatenate(parts), return_inverse=True)
        again = (np.bincount(where) + np.bincount(where, twice)) > 1
        hit, at = again[where], 0
        for r, p in zip(rows, parts):
            mine = p[hit[at:at + len(p)]]
            at += len(p)
            if len(mine):
                out.append({"shard": r["shard"], "hashes": mine.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int64()), ("hashes", pa.binary())]))

    sent = shards.mapInArrow(tidy(send), "task long, shard long, hashes binary, twice binary")
    return sent.groupBy("task").applyInArrow(meet, "shard long, hashes binary")


def _cut(row: dict, keep_text: bool) -> Iterator[dict]:
    cover, starts, hashes = _start_hashes(row)
    if row["repeated"]:
        known = np.unique(np.concatenate([np.frombuffer(h, np.uint64) for h in row["repeated"]]))
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        starts = starts[known[at] == hashes]
    else:
        starts = starts[:0]
    begin = np.frombuffer(row["starts"], np.int64)
    change = np.zeros(int(begin[-1]) + 1, np.int32)
    first, last = (np.frombuffer(row[c], np.int64)[cover] for c in ("firsts", "lasts"))
    np.add.at(change, np.concatenate([first, starts]), 1)
    np.add.at(change, np.concatenate([last, starts]) + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    text = _text(row)
    for i, doc_id in enumerate(row["doc_ids"]):
        a, b = begin[i], begin[i + 1]
        mask = gone[a:b]
        n = int(np.count_nonzero(mask))
        edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0)) if n else np.empty(0, np.int64)
        kept = (text[a:b][~mask] if n else text[a:b]).tobytes()
        yield {"doc_id": doc_id, "n_bytes": int(b - a), "n_removed": n, "n_spans": len(edges) // 2,
               "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": edges.reshape(-1, 2).tolist(),
               "kept": kept if keep_text else None}


RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, "
          "kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept), one row per document.

    ``spans`` are the removed [begin, end) byte ranges, ``kept`` the remaining bytes if ``keep_text``.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    shards = scratch.write(build_shards(docs, id_col, text_col), "shards")
    size = docs.agg(F.sum(F.octet_length(utf8(F.col(text_col))))).first()[0] or 0
    tasks = max(8, -(-size // MERGE_BYTES))
    verdicts = scratch.write(merge_entries(shard_entries(shards), tasks), "verdicts")
    told = verdicts.groupBy("shard").agg(F.collect_list(F.struct("class", "flag")).alias("verdicts"))
    columns = ["shard", "firsts", "lasts", "classes", "flags", "uses", "text", "verdicts"]
    marked = shards.drop("anchors", "tables").join(told, "shard", "left")
    repeated = scratch.write(repeated_starts(marked.select(columns), tasks), "repeated")
    both = marked.join(repeated.groupBy("shard").agg(F.collect_list("hashes").alias("repeated")), "shard", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                        ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(list(_cut(batch.slice(i, 1).to_pylist()[0], keep_text)), schema)

    return both.mapInArrow(tidy(cut), RESULT)
