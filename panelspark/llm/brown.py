"""Class-based bigram scoring (Brown et al., 1992) with exchange clustering.

1. Counts of all training tokens (every training document, whole texts).
2. Symbols: the ``CLUSTERED`` most frequent tokens, the end token, and for all
   other tokens one of ``SUFFIXES`` suffix groups. Symbol bigrams of the whole
   training part are counted; the matrix has a fixed size.
3. The exchange algorithm moves symbols between ``CLASSES`` classes while the
   likelihood of the class bigram model rises.
4. Every other training token starts in the class of its suffix group. In each
   of ``ASSIGN_SWEEPS`` sweeps the classes before and after it are counted over
   all training texts and it moves to the class of the highest exchange gain.
   All tokens of a sweep are moved against the same class bigrams, in tasks; so
   none moves to a class without tokens, and a sweep that does not raise the
   likelihood is not taken.
5. log P(text) = sum of log P(class | class before) + log P(token | class); the
   class transitions are interpolated with the class unigrams, tokens are
   additively smoothed with one share for the unseen tokens of each suffix group
   (in that group's class), so all distributions are proper.

Texts are coded once, many documents to a packed row ("shard"): the ``HEAD`` most
frequent tokens (a fixed number) by their place, others ("rare" tokens) by their
suffix group, with 64-bit hashes of the rare tokens beside the codes. No row is
made for a token or a bigram: a shard sends its distinct rare tokens, packed by
hash bucket, with the classes around them, and each bucket task answers every
shard with the classes and counts of the tokens it asked for.

Defined results: null text is empty (one end token); without training rows all
counts are 0 and both scores are finite; repeated rows are scored separately;
a null id falls in the fold of the empty string; other columns are ignored. Rare
tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, tidy, utf8

FOLDS, HELD_OUT = 10, 0
CLUSTERED, SUFFIXES, CLASSES, HEAD, LONGEST_HEAD = 1000, 128, 48, 150_000, 64
SHARE = 0.1
SWEEPS, ASSIGN_SWEEPS = 6, 2
BACKOFF = 20.0
FLUSH_TOKENS, SHARD_TOKENS = 400_000, 400_000
BUCKET_TOKENS = 1_000_000          # rare tokens, as often as they occur, that one task classes
END = CLUSTERED + SUFFIXES
SYMBOLS = END + 1
ROWS_PER_STRIP, WORDS_PER_STRIP = 64, 2048
AFTER, BEFORE, ITSELF = 0, CLASSES, 2 * CLASSES       # columns of a token's contexts
CONTEXTS = 2 * CLASSES + 1


def tokens_of(text: bytes) -> list[bytes]:
    """Runs without ASCII white space; ASCII letters in lower case."""
    return text.lower().split()


def suffix_symbol(token: bytes) -> int:
    return CLUSTERED + zlib.crc32(token[-3:]) % SUFFIXES


class CodeOf(dict):
    """Code of a token: its place when frequent, else the number of frequent tokens plus its suffix group."""

    def __missing__(self, token: bytes) -> int:
        return len(self) + suffix_symbol(token) - CLUSTERED


def count_tokens(train: DataFrame) -> DataFrame:
    """(token binary, n) over all training texts."""
    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                          ["token", "n"])

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(tokens_of(text.as_py()))
                if len(seen) > FLUSH_TOKENS:
                    yield batch_of(seen)
                    seen = Counter()
        yield batch_of(seen)

    return train.select("text").mapInArrow(tidy(count), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent_tokens(counts: DataFrame, most: int | None = None) -> list[tuple[bytes, int]]:
    """At most ``most`` (``HEAD``) tokens with the highest counts, most frequent first.

    The least count is found from a histogram of counts (sixteenths of powers
    of two), so no task or driver sorts the vocabulary. Of the step at the border
    those tokens are taken that come first by a hash, in buckets.
    """
    most = HEAD if most is None else most
    step = F.floor(F.log2("n") * F.lit(16))
    short = counts.where(F.octet_length("token") <= LONGEST_HEAD).withColumn("step", step)
    kept, chosen = 0, F.lit(False)
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        if kept + r["count"] <= most:
            kept += r["count"]
            chosen = F.col("step") >= r["step"]
            continue
        bucket = F.pmod(F.xxhash64("token"), F.lit(min(1 << 16, 1 + 64 * r["count"] // most)))
        border, last = F.col("step") == r["step"], -1
        for x in sorted(short.where(border).groupBy(bucket.alias("bucket")).count().collect()):
            kept += x["count"]
            if kept > most:
                break
            last = x["bucket"]
        chosen = chosen | (border & (bucket <= last))
        break
    rows = short.where(chosen).select("token", "n").toArrow()
    return sorted(zip(rows.column("token").to_pylist(), rows.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))


SHARDS = "shard long, held_out boolean, doc_ids array<long>, lengths binary, codes binary, rare binary"
SHARDS_ARROW = pa.schema([("shard", pa.int64()), ("held_out", pa.bool_()), ("doc_ids", pa.list_(pa.int64())),
                          *[(c, pa.binary()) for c in ("lengths", "codes", "rare")]])


def code_texts(rows: DataFrame, head: list[bytes]) -> DataFrame:
    """Packed documents of about ``SHARD_TOKENS`` tokens: lengths, codes and the hashes of the rare tokens, in order.

    Training and held-out documents are packed apart.
    """
    shared, rare = rows.sparkSession.sparkContext.broadcast(head), len(head)

    def code(batches):
        of, squeeze = CodeOf((t, i) for i, t in enumerate(shared.value)).__getitem__, zstandard.ZstdCompressor(level=3)
        held: dict[bool, list] = {False: [], True: []}
        size, shard = {False: 0, True: 0}, TaskContext.get().partitionId() << 32

        def packed(flag):
            nonlocal shard
            doc_ids, codes, hashes = zip(*held[flag])
            row = [shard, flag, list(doc_ids), np.array([len(c) for c in codes], np.int64).tobytes(),
                   squeeze.compress(np.concatenate(codes).tobytes()), b"".join(hashes)]
            held[flag], size[flag], shard = [], 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SHARDS_ARROW)], schema=SHARDS_ARROW)

        for batch in batches:
            for doc_id, flag, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(),
                                          batch.column("text")):
                found = tokens_of(text.as_py())
                codes = np.fromiter(map(of, found), np.int32, len(found))
                hashes = [xxhash.xxh3_64_intdigest(found[i]) for i in np.flatnonzero(codes >= rare).tolist()]
                held[flag].append((doc_id, codes, np.array(hashes, np.uint64).tobytes()))
                size[flag] += len(codes) + 1
                if size[flag] > SHARD_TOKENS:
                    yield packed(flag)
        for flag in held:
            if held[flag]:
                yield packed(flag)

    return rows.mapInArrow(tidy(code), SHARDS)


class Shard:
    """A packed row as one sequence of codes: an end before the first document and after each of them."""

    def __init__(self, row: dict, n_frequent: int):
        self.rare, self.end = n_frequent, n_frequent + SUFFIXES
        lengths = np.frombuffer(row["lengths"], np.int64)
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.int32)
        self.codes = np.full(len(codes) + len(lengths) + 1, self.end, np.int64)
        self.codes[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = codes
        self.first = np.cumsum(lengths + 1) - lengths - 1           # of each document, counted behind the leading end
        self.lengths, self.number, self.held_out, self.doc_ids = lengths, row["shard"], row["held_out"], row["doc_ids"]
        self.at = np.flatnonzero((self.codes >= self.rare) & (self.codes < self.end))
        self.hashes, place, self.token = np.unique(np.frombuffer(row["rare"], np.uint64), return_index=True, return_inverse=True)
        self.code = self.codes[self.at[place]]                      # of each distinct rare token

    def parts(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, distinct rare tokens in it)."""
        of = (self.hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        return [(int(of[p[0]]), p) for p in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(p)]

    def told(self, label: np.ndarray, answers: list[dict] | None, buckets: int, use_old: bool = False):
        """(class of each distinct rare token, its training count): its suffix group's class where it is not known."""
        classes, counts = label[self.code].copy(), np.zeros(len(self.hashes), np.int64)
        if answers is not None:
            of = {a["key"]: a for a in answers}
            for bucket, mine in self.parts(buckets):
                new = np.frombuffer(of[bucket]["old" if use_old else "classes"], np.int8).astype(np.int64)
                classes[mine] = np.where(new >= 0, new, classes[mine])
                counts[mine] = np.frombuffer(of[bucket]["counts"], np.int64)
        return classes, counts

    def classes(self, label: np.ndarray, rare_classes: np.ndarray) -> np.ndarray:
        """Class at each place of the sequence."""
        out = label[self.codes]
        out[self.at] = rare_classes[self.token]
        return out


def _shards(batches, n_frequent: int):
    """(shard, answers to it or None), one packed row at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield Shard(row, n_frequent), row.get("answers")


def _with_answers(shards: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Each packed row with the answers to it; a row without rare tokens asks and gets nothing."""
    if answers is None:
        return shards
    mine = answers.where("shard >= 0").groupBy("shard").agg(F.collect_list(F.struct("key", "classes", "old", "counts")).alias("answers"))
    nothing = F.array().cast(mine.schema["answers"].dataType)
    return shards.join(mine, "shard", "left").withColumn("answers", F.coalesce("answers", nothing))


def _strips(total: np.ndarray, rows: int) -> pa.RecordBatch:
    """Compressed strips of ``rows`` rows of a matrix, without those that are zero."""
    parts = [(at, total[at:at + rows]) for at in range(0, len(total), rows)]
    parts = [(at, zlib.compress(part.astype(np.int64).tobytes(), 1)) for at, part in parts if part.any()]
    return pa.RecordBatch.from_arrays([pa.array([at for at, _ in parts], pa.int64()),
                                       pa.array([part for _, part in parts], pa.binary())], ["at", "strip"])


def _added(table: pa.Table) -> np.ndarray:
    return sum(np.frombuffer(zlib.decompress(s), np.int64) for s in table.column("strip").to_pylist())


def symbol_bigrams(shards: DataFrame, of_code: np.ndarray) -> np.ndarray:
    """(SYMBOLS, SYMBOLS) counts of the codes' symbols; the end symbol also stands before the first token."""
    n_frequent = len(of_code) - 1 - SUFFIXES

    def count(batches):
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for shard, _ in _shards(batches, n_frequent):
            symbols = of_code[shard.codes]
            total += np.bincount(symbols[:-1] * SYMBOLS + symbols[1:], minlength=SYMBOLS * SYMBOLS)
        yield _strips(total.reshape(SYMBOLS, SYMBOLS), ROWS_PER_STRIP)

    def add(key, table):
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "strip": pa.array([_added(table).tobytes()], pa.binary())})

    out = np.zeros((SYMBOLS, SYMBOLS))
    for r in (shards.mapInArrow(tidy(count), "at long, strip binary").groupBy("at").applyInArrow(add, "at long, strip binary")
              .collect()):
        rows = np.frombuffer(r["strip"], np.int64).reshape(-1, SYMBOLS)
        out[r["at"]:r["at"] + len(rows)] = rows
    return out


CONTEXT_ROWS = "key long, shard long, hashes binary, classes binary, uses binary, places binary, counts binary"
_CONTEXT_NAMES = [c.split()[0] for c in CONTEXT_ROWS.split(", ")]
ANSWERS = "key long, shard long, classes binary, old binary, counts binary, n long, kinds long"
_ANSWER_NAMES = [c.split()[0] for c in ANSWERS.split(", ")]
STRIP_OF_CLASSES, MASS_NEW, MASS_OLD, BIGRAMS = -1, -2, -3, -4    # numbers in place of a shard's


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], _CONTEXT_NAMES)


def contexts(shards: DataFrame, label: np.ndarray, answers: DataFrame | None, buckets: int) -> DataFrame:
    """What stands around every token of the training texts that the exchange did not place, under the given classes.

    Rows for the strips of frequent tokens (key: -1 - strip), for the buckets of rare tokens (key: bucket), and the
    class bigrams (shard ``BIGRAMS``, key: first class). Held-out shards ask for their rare tokens only.
    """
    rare = len(label) - 1 - SUFFIXES

    def around(batches):
        total, bigrams, used = np.zeros((rare, CONTEXTS), np.int32), np.zeros(CLASSES * CLASSES, np.int64), False
        for shard, told in _shards(batches, rare):
            own, _ = shard.told(label, told, buckets)
            cls, codes = shard.classes(label, own), shard.codes
            identity = codes.copy()
            identity[shard.at] = shard.end + 1 + shard.token
            a, b, itself = identity[:-1], identity[1:], identity[:-1] == identity[1:]
            token, place = np.concatenate([a, b[~itself]]), np.concatenate([np.where(itself, ITSELF, AFTER + cls[1:]),
                                                                            (BEFORE + cls[:-1])[~itself]])
            if shard.held_out:
                token, place = token[:0], place[:0]
            else:
                bigrams += np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
                frequent = (token >= CLUSTERED) & (token < rare)
                if frequent.any():
                    cell, n = np.unique(token[frequent] * CONTEXTS + place[frequent], return_counts=True)
                    total.ravel()[cell] += n.astype(np.int32)
                    used = True
            mine = token > shard.end
            cell, n = np.unique((token[mine] - shard.end - 1) * CONTEXTS + place[mine], return_counts=True)
            uses = np.bincount(cell // CONTEXTS, minlength=len(shard.hashes))
            begin, rows = np.cumsum(uses) - uses, []
            for bucket, tokens in shard.parts(buckets):
                size = uses[tokens]
                entry = np.repeat(begin[tokens] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rows.append((bucket, shard.number, shard.hashes[tokens].tobytes(), own[tokens].astype(np.int8).tobytes(),
                             size.astype(np.int32).tobytes(), (cell[entry] % CONTEXTS).astype(np.uint8).tobytes(),
                             n[entry].astype(np.int32).tobytes()))
            yield _context_batch(rows)
        rows = [(k, BIGRAMS, b"", b"", b"", b"", bigrams[k * CLASSES:(k + 1) * CLASSES].tobytes()) for k in range(CLASSES)]
        if used:
            flat, step = total.ravel(), WORDS_PER_STRIP * CONTEXTS
            cell = np.flatnonzero(flat)
            edges = np.searchsorted(cell, np.arange(0, len(flat) + step, step))
            rows += [(-1 - k, STRIP_OF_CLASSES, b"", b"", b"", (cell[a:b] - k * step).astype(np.uint32).tobytes(), flat[cell[a:b]].tobytes())
                     for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        yield _context_batch(rows)

    return _with_answers(shards, answers).mapInArrow(tidy(around), CONTEXT_ROWS)


def class_bigrams(rows: DataFrame) -> np.ndarray:
    """(CLASSES, CLASSES) sums of the ``BIGRAMS`` rows."""
    def add(key, table):
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([sum(
            np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()).tobytes()], pa.binary())})

    out = np.zeros((CLASSES, CLASSES))
    for r in rows.where(F.col("shard") == BIGRAMS).select("key", "counts").groupBy("key").applyInArrow(add, "key long, counts binary").collect():
        out[r["key"]] = np.frombuffer(r["counts"], np.int64)
    return out


def bigrams_under(shards: DataFrame, label: np.ndarray, answers: DataFrame, buckets: int) -> np.ndarray:
    """Class bigrams of the training texts under the answers (without the contexts)."""
    rare = len(label) - 1 - SUFFIXES

    def count(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for shard, told in _shards(batches, rare):
            cls = shard.classes(label, shard.told(label, told, buckets)[0])
            total += np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
        yield _context_batch([(k, BIGRAMS, b"", b"", b"", b"", total[k * CLASSES:(k + 1) * CLASSES].tobytes()) for k in range(CLASSES)])

    return class_bigrams(_with_answers(shards, answers).mapInArrow(tidy(count), CONTEXT_ROWS))


def best_classes(contexts: np.ndarray, old: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Class of the highest exchange gain of each token, against the class bigrams without the token.

    ``contexts``: how often each class stands after and before the token, other
    than itself, and how often it follows itself. Only cells that the token
    changes are computed. Classes without other tokens are not taken.
    """
    after, before = contexts[:, AFTER:BEFORE].astype(float), contexts[:, BEFORE:ITSELF].astype(float)
    itself, at = contexts[:, ITSELF].astype(float), np.arange(len(contexts))
    gain = np.zeros((len(contexts), CLASSES))
    for mine, other, table in ((after, before, between), (before, after, between.T)):
        token, c = np.nonzero(mine)
        n, here = mine[token, c][:, None], np.arange(len(token))
        cells = table[:, c].T.copy()                      # [entry, class the token may take]
        cells[here, old[token]] -= n[:, 0]
        own = c == old[token]
        cells[own] -= other[token[own]]
        change = _xlogx(np.maximum(cells, 0) + n) - _xlogx(np.maximum(cells, 0))
        change[here, c] = 0                               # the diagonal follows
        np.add.at(gain, token, change)
    cells = np.repeat(np.diag(between)[None], len(contexts), 0)
    both = after + before + itself[:, None]
    cells[at, old] -= both[at, old]
    gain += _xlogx(cells + both) - _xlogx(cells)
    for n, size in ((after.sum(1) + itself, between.sum(1)), (before.sum(1) + itself, between.sum(0))):
        size = np.repeat(size[None], len(contexts), 0)
        size[at, old] -= n
        gain -= _xlogx(size + n[:, None]) - _xlogx(size)
        gain[(size <= 0) & (np.arange(CLASSES) != old[:, None])] = -np.inf
    new = np.argmax(gain[:, :CLASSES - 1], axis=1)
    return np.where(gain[at, new] > gain[at, old] + 1e-9, new, old)


def assign(rows: DataFrame, label: np.ndarray, between: np.ndarray) -> DataFrame:
    """``ANSWERS``: new and old class and training count of every rare token to each shard that has it, new classes of the
    frequent tokens by strip, and the sizes of the classes."""
    def strip(key, table):
        at = (-1 - key) * WORDS_PER_STRIP
        found = np.zeros(min(WORDS_PER_STRIP, len(label) - 1 - SUFFIXES - at) * CONTEXTS, np.int64)
        for cells, counts in zip(table.column("places").to_pylist(), table.column("counts").to_pylist()):
            found[np.frombuffer(cells, np.uint32)] += np.frombuffer(counts, np.int32)
        found = found.reshape(-1, CONTEXTS)
        old, used = label[at:at + len(found)], np.flatnonzero(found.any(axis=1))
        new = old.copy()
        for k in range(0, len(used), 256):
            some = used[k:k + 256]
            new[some] = best_classes(found[some], old[some], between)
        return [(at, STRIP_OF_CLASSES, new.tobytes(), b"", b"", 0, 0)]

    def bucket(key, table):
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        join = lambda c, t: np.concatenate([np.frombuffer(v, t) for v in table.column(c).to_pylist()])
        tokens, first, of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        old = join("classes", np.int8)[first].astype(np.int64)
        owner, place, n = np.repeat(of, join("uses", np.int32)), join("places", np.uint8), join("counts", np.int32)
        order = np.argsort(owner, kind="stable")
        owner, place, n = owner[order], place[order].astype(np.int64), n[order]
        new, count = old.copy(), np.zeros(len(tokens), np.int64)
        for k in range(0, len(tokens), 2048):
            a, b = np.searchsorted(owner, (k, k + 2048))
            size = min(2048, len(tokens) - k)
            found = np.zeros((size, CONTEXTS), np.int64)
            np.add.at(found, (owner[a:b] - k, place[a:b]), n[a:b])
            count[k:k + size] = found[:, AFTER:BEFORE].sum(1) + found[:, ITSELF]
            new[k:k + size] = best_classes(found, old[k:k + size], between)
        seen = count > 0
        new[~seen] = -1                                    # only held-out texts have it
        out, at = [], 0
        told = np.where(seen, old, -1).astype(np.int8)
        for shard, mine in zip(table.column("shard").to_pylist(), hashes):
            here, at = of[at:at + len(mine)], at + len(mine)
            out.append((key, shard, new[here].astype(np.int8).tobytes(), told[here].tobytes(), count[here].tobytes(), 0, 0))
        for what, classes in ((MASS_NEW, new[seen]), (MASS_OLD, old[seen])):
            sums, kinds = np.bincount(classes, count[seen], CLASSES), np.bincount(classes, minlength=CLASSES)
            out += [(int(c), what, b"", b"", b"", int(sums[c]), int(kinds[c])) for c in np.flatnonzero(kinds)]
        return out

    def answer(key, table):
        number = key[0].as_py()
        out = strip(number, table) if number < 0 else bucket(number, table)
        types = (pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=_ANSWER_NAMES)

    return rows.where(F.col("shard") != BIGRAMS).groupBy("key").applyInArrow(answer, ANSWERS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(between: np.ndarray) -> float:
    """Log-likelihood of the class bigram model, but for what does not depend on the classes."""
    return float(_xlogx(between).sum() - _xlogx(between.sum(1)).sum() - _xlogx(between.sum(0)).sum())


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every symbol; the end symbol keeps the last class to itself."""
    free, end = classes - 1, len(bigrams) - 1
    n_out, n_in = bigrams.sum(1), bigrams.sum(0)
    order = [s for s in np.lexsort((np.arange(len(bigrams)), -n_out)) if s != end]
    label = np.zeros(len(bigrams), np.int64)
    label[order] = np.arange(len(order)) % free
    label[end] = free
    member = np.zeros((len(bigrams), classes))
    member[np.arange(len(bigrams)), label] = 1
    between = member.T @ bigrams @ member
    out_of, into = member.T @ n_out, member.T @ n_in
    for _ in range(sweeps):
        moved = 0
        for s in order:
            right, left, self_ = bigrams[s] @ member, member.T @ bigrams[:, s], bigrams[s, s]
            old = label[s]
            right[old] -= self_                     # without the symbol's own bigram
            left[old] -= self_
            between[old] -= right
            between[:, old] -= left
            between[old, old] -= self_
            out_of[old] -= n_out[s]
            into[old] -= n_in[s]
            base = _xlogx(between)
            rows = _xlogx(between + right[None, :]) - base
            cols = _xlogx(between + left[:, None]) - base
            diag = np.diag(between)
            gain = (rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols)
                    + _xlogx(diag + right + left + self_) - _xlogx(diag)
                    - _xlogx(out_of + n_out[s]) + _xlogx(out_of) - _xlogx(into + n_in[s]) + _xlogx(into))
            new = int(np.argmax(gain[:free]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            between[new] += right
            between[:, new] += left
            between[new, new] += self_
            out_of[new] += n_out[s]
            into[new] += n_in[s]
            if new != old:
                member[s, old], member[s, new], label[s] = 0, 1, new
                moved += 1
        if not moved:
            break
    return label


def class_steps(between: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """P(class | class before), interpolated with the class unigrams."""
    return (between + BACKOFF * mass / mass.sum()) / (between.sum(1, keepdims=True) + BACKOFF)


def transition_table(bigrams: np.ndarray, label: np.ndarray, group_mass: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) + log10 P(symbol | class) - log10(group mass), by symbol pair (the symbols alone)."""
    member = np.eye(CLASSES)[label]
    uses = bigrams.sum(0) + SHARE
    class_uses = member.T @ uses
    emission = np.log10(uses / class_uses[label])
    emission[CLUSTERED:END] -= np.log10(group_mass)
    return np.log10(class_steps(member.T @ bigrams @ member, class_uses))[np.ix_(label, label)] + emission[None, :]


@dataclass
class Classes:
    """Classes of all training tokens: of the codes, and of the rare tokens as answers to the shards that have them."""

    label: np.ndarray
    answers: DataFrame
    use_old: bool
    buckets: int
    between: np.ndarray
    masses: dict                       # class: (draws, kinds) of the rare tokens


def cluster(scratch: Scratch, shards: DataFrame, head: list[bytes], rare_uses: int) -> Classes:
    """Exchange clustering of the head, then ``ASSIGN_SWEEPS`` sweeps over all other tokens."""
    symbols = [i if i < CLUSTERED else suffix_symbol(t) for i, t in enumerate(head)]
    of_code = np.array([*symbols, *range(CLUSTERED, END), END], np.int64)
    bigrams = symbol_bigrams(shards.where(~F.col("held_out")), of_code)
    placed = exchange(bigrams)
    label, member = placed[of_code], np.eye(CLASSES)[placed]
    between, answers, buckets = member.T @ bigrams @ member, None, max(8, -(-rare_uses // BUCKET_TOKENS))
    found = contexts(shards, label, None, buckets)
    for sweep in range(1, ASSIGN_SWEEPS + 1):
        new, last = label.copy(), sweep == ASSIGN_SWEEPS
        before, answers = answers, scratch.write(assign(found, label, between), f"answers{sweep}")
        for r in answers.where(F.col("shard") == STRIP_OF_CLASSES).select("key", "classes").collect():
            mine = np.frombuffer(r["classes"], label.dtype)
            new[r["key"]:r["key"] + len(mine)] = mine
        if last:
            after = bigrams_under(shards.where(~F.col("held_out")), new, answers, buckets)
        else:                                              # one pass gives this sweep's bigrams and the next one's contexts
            found = scratch.write(contexts(shards, new, answers, buckets), f"contexts{sweep}")
            after = class_bigrams(found)
        if sweep > 1:
            scratch.drop(f"contexts{sweep - 1}", f"answers{sweep - 1}")
        use_old = likelihood(after) <= likelihood(between)
        if use_old:
            break
        label, between = new, after
    masses = {r["key"]: (r["n"], r["kinds"]) for r in answers.where(F.col("shard") == (MASS_OLD if use_old else MASS_NEW))
              .groupBy("key").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()}
    return Classes(label, answers, use_old, buckets, between, masses)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
                       utf8(F.col(text_col)).alias("text"))
    counts = scratch.write(count_tokens(rows.where(~F.col("held_out"))), "counts")
    total, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    frequent = frequent_tokens(counts)
    scratch.drop("counts")
    head = [t for t, _ in frequent]
    shards = scratch.write(code_texts(rows, head), "shards")
    texts, rare_uses = shards.agg(F.sum(F.when(F.col("held_out"), 0).otherwise(F.size("doc_ids"))),
                                  F.sum(F.octet_length("rare") / 8)).first()
    texts = texts or 0
    n, v = (total or 0) + texts, kinds + (texts > 0)
    model = cluster(scratch, shards, head, int(rare_uses or 0))
    label, buckets, use_old = model.label, model.buckets, model.use_old
    own = np.array([*(c for _, c in frequent), *[0] * SUFFIXES, texts], float)
    mass = np.bincount(label, own + SHARE, CLASSES)        # a suffix group's share is for its unseen tokens
    for c, (uses, different) in model.masses.items():
        mass[c] += uses + SHARE * different
    with np.errstate(divide="ignore"):                     # a class without tokens is never stepped into
        steps, mass_log = np.log10(class_steps(model.between, mass)), np.log10(mass)
    logs, norm = np.log10(own + SHARE), log10(n + SHARE * (v + 1))
    first_rare, known_end = len(head), int(texts > 0)

    def score(batches):
        for shard, told in _shards(batches, first_rare):
            own_classes, found = shard.told(label, told, buckets, use_old)
            cls, token_logs = shard.classes(label, own_classes), logs[shard.codes]
            token_logs[shard.at] = np.log10(found + SHARE)[shard.token]
            known = (shard.codes < first_rare).astype(np.int64)
            known[shard.at] = (found > 0)[shard.token]
            path = steps[cls[:-1], cls[1:]] + token_logs[1:] - mass_log[cls[1:]]
            n_tokens = shard.lengths + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array([shard.held_out] * len(n_tokens), pa.bool_()), pa.array(n_tokens),
                 pa.array(np.add.reduceat(known[1:], shard.first) + known_end), pa.array([n] * len(n_tokens), pa.int64()),
                 pa.array(np.add.reduceat(token_logs[1:], shard.first) - n_tokens * norm), pa.array(np.add.reduceat(path, shard.first))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with_answers(shards, model.answers).mapInArrow(
        tidy(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
