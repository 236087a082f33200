"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: each segment row holds whole documents of
about ``SEGMENT_WORDS`` words, their sorted terms, and for each term the
ascending word positions of all its postings (delta-coded, one array per
segment). Documents are separated by an unused position, so no phrase crosses
them. Segments are written once and searched without any shuffle.

A phrase is found by taking the posting list of its rarest term in the
segment, shifted by the term's offset, and intersecting it with the shifted
lists of the next rarer terms until it is empty or all terms agree.

Test items are read in blocks of a bounded number of words, one broadcast per
block, so the benchmark may grow. Occurrences are merged per segment, whose
size bounds them.

Defined results: null or wordless texts have no words; items without words
are ignored; items with the same id count once, a null id is the empty string;
repeated documents are separate rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy, utf8

WINDOW = 10
SEGMENT_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000
SEGMENT = ("segment long, doc_ids array<long>, starts binary, lengths binary, terms array<binary>, "
           "ends binary, postings binary")
SEGMENT_ARROW = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.binary()),
                           ("lengths", pa.binary()), ("terms", pa.list_(pa.binary())), ("ends", pa.binary()),
                           ("postings", pa.binary())])
#: Words are runs of digits, letters and non-ASCII bytes, ASCII letters in lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _segment_batch(number: int, doc_ids: list, lengths: list[int], words: list[bytes]) -> pa.RecordBatch:
    lens = np.array(lengths, np.int64)
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]).astype(np.int64)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    terms = sorted(seen)
    rank = np.empty(len(seen), np.int64)
    rank[[seen[t] for t in terms]] = np.arange(len(terms))
    ids = rank[ids] if len(ids) else ids
    positions = np.arange(len(words)) + np.repeat(np.arange(len(lens)), lens)
    postings = positions[np.argsort(ids, kind="stable")]
    ends = np.cumsum(np.bincount(ids, minlength=len(terms)))
    row = [[number], [doc_ids], [starts.tobytes()], [lens.tobytes()], [terms], [ends.astype(np.int32).tobytes()],
           [np.diff(postings, prepend=0).astype(np.int32).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, SEGMENT_ARROW)], schema=SEGMENT_ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Positional postings of every word of every document, as segment rows."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        doc_ids, lengths, words = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                found = words_of(text.as_py())
                doc_ids.append(doc_id)
                lengths.append(len(found))
                words += found
                if len(words) >= segment_words:
                    yield _segment_batch(number, doc_ids, lengths, words)
                    number, doc_ids, lengths, words = number + 1, [], [], []
        if doc_ids:
            yield _segment_batch(number, doc_ids, lengths, words)

    return (docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("text"))
            .mapInArrow(tidy(index), SEGMENT))


class Segment:
    """One searchable segment of the index."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["segment"], row["doc_ids"]
        self.starts, self.lengths = (np.frombuffer(row[k], np.int64) for k in ("starts", "lengths"))
        self.term = {t: i for i, t in enumerate(row["terms"])}
        self.ends = np.concatenate([[0], np.frombuffer(row["ends"], np.int32)])
        self.postings = np.cumsum(np.frombuffer(row["postings"], np.int32), dtype=np.int64)

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.ends[term]:self.ends[term + 1]]

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Start positions of the exact phrase (term numbers, none missing)."""
        size = [self.ends[t + 1] - self.ends[t] for t in terms]
        order = sorted(range(len(terms)), key=size.__getitem__)
        starts = self.positions(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            there = self.positions(terms[k])
            at = np.searchsorted(there, starts + k)
            starts = starts[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] == starts + k)]
        return starts

    def near(self, terms: list[int], span: int) -> np.ndarray:
        """Left ends of stretches of at most ``span`` words of one document with all the terms."""
        lists = [self.positions(t) for t in terms]
        left = np.unique(np.concatenate(lists))
        right = left.copy()
        for there in lists:
            at = np.searchsorted(there, left)
            right = np.maximum(right, np.where(at < len(there), there[np.minimum(at, len(there) - 1)], left + span))
        return left[(right - left < span) & (self.doc_of(left) == self.doc_of(right))]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment(batch.slice(i, 1).to_pylist()[0])


def _item_spans(seg: Segment, words: list[bytes], window: int) -> Iterator[tuple[int, int]]:
    """Merged [start, end) position runs covered by occurrences of the item's windows."""
    terms = [seg.term.get(w, -1) for w in words]
    size = min(window, len(terms))
    found = [seg.phrase(terms[i:i + size]) for i in range(len(terms) - size + 1) if min(terms[i:i + size]) >= 0]
    starts = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1) if len(starts) else ():
        yield int(run[0]), int(run[-1]) + size      # the gap between documents splits runs


def occurrences(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> DataFrame:
    """(segment, item, first, last): covered word runs of each item, ``last`` excluded."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        for seg in segments(batches):
            rows = [(seg.number, item, a, b) for item, words in shared.value for a, b in _item_spans(seg, words, window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                ["segment", "item", "first", "last"])

    return index.mapInArrow(tidy(search), "segment long, item string, first long, last long")


def near_matches(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """(doc_id, n_matches): documents with all the terms within ``span`` words (proximity search)."""
    wanted = [w for t in terms for w in words_of(t.encode())]

    def search(batches):
        for seg in segments(batches):
            numbers = [seg.term.get(w, -1) for w in dict.fromkeys(wanted)]
            left = seg.near(numbers, span) if numbers and min(numbers) >= 0 else np.empty(0, np.int64)
            docs, counts = np.unique(seg.doc_of(left), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([seg.doc_ids[d] for d in docs], pa.int64()),
                                              pa.array(counts, pa.int64())], ["doc_id", "n_matches"])

    return index.mapInArrow(tidy(search), "doc_id long, n_matches long")


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items in blocks of about ``BLOCK_WORDS`` words."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                            utf8(F.col(text_col)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (5 * BLOCK_WORDS)))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct()
        yield [(r["item"], found) for r in block.collect() if (found := words_of(bytes(r["text"])))]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items), one row per document."""
    index = Scratch(docs.sparkSession, "postings").write(build_index(docs, id_col, text_col), "index")
    hits = None
    for items in _item_blocks(benchmark, item_col, item_text):
        found = occurrences(index, items, window)
        hits = found if hits is None else hits.unionByName(found)
    per_segment = hits.groupBy("segment").agg(F.collect_list(F.struct("item", "first", "last")).alias("hits"))

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                starts, lens = (np.frombuffer(row[k], np.int64) for k in ("starts", "lengths"))
                change = np.zeros(int(starts[-1] + lens[-1]) + 2, np.int64)
                items: list[set] = [set() for _ in starts]
                for hit in row["hits"] or ():
                    change[hit["first"]] += 1
                    change[hit["last"]] -= 1
                    items[int(np.searchsorted(starts, hit["first"], side="right")) - 1].add(hit["item"])
                covered = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
                n_hit = covered[starts + lens] - covered[starts]
                named = [sorted(s) for s in items]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(lens, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array([len(s) for s in named], pa.int64()),
                     pa.array([hashlib.sha256(",".join(s).encode()).hexdigest() for s in named], pa.string()),
                     pa.array(n_hit > 0, pa.bool_()), pa.array(named, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    return (index.select("segment", "doc_ids", "starts", "lengths").join(per_segment, "segment", "left")
            .mapInArrow(tidy(count), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
                               "contaminated boolean, items array<string>"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """The documents in which no window of a test item occurs, with all their columns.

    Verdicts return to the rows by a 64-bit hash of id and text, so null and repeated ids are safe.
    """
    number = F.xxhash64(F.col(id_col), utf8(F.col(text_col))).alias("number")
    bad = (contamination(docs.select(number, F.col(text_col).alias("text")), benchmark, id_col="number", text_col="text", **options)
           .where("contaminated").select(F.col("doc_id").alias("number")).distinct())
    return (docs.select(F.struct(*docs.columns).alias("whole"), number).join(bad, "number", "left_anti").select("whole.*"))
