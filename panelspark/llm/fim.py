"""Fill-in-middle documents by in-place block rotation.

A text is a sequence of units (a run of ASCII letters, or any other single
code point). Two cuts, drawn from a hash of the id, give prefix, middle and
suffix. The cuts are found by scanning the UTF-8 bytes in blocks; the
sentinels are inserted in a ``bytearray`` in the order of the text
(``<P>`` prefix ``<M>`` middle ``<S>`` suffix), and two neighbouring segments
are exchanged by three reversals of that buffer:

* ``psm``: ``<M>`` middle and ``<S>`` suffix change places;
* ``spm``: ``<S>`` suffix moves before everything else.

``restore`` finds the sentinels (a text that holds one is left ``plain``, so
they are unique), applies the inverse rotation and takes them out again.
Memory per document is the buffer and one block. Rows are independent: one
narrow pass, no shuffle.

Defined results: null text is empty, and empty texts are ``plain``; a null id
is hashed as the empty string; equal ids have equal draws, so repeated rows
give equal results; a cut may fall at either end, and both cuts may be the
same (empty segments); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
FIM_PERCENT, SPM_PERCENT = 90, 20
BLOCK = 1 << 20                     # bytes that are scanned or swapped at a time
_WIDTH = len(PREFIX)

_LETTER = np.zeros(256, bool)
_LETTER[list(range(ord("A"), ord("Z") + 1)) + list(range(ord("a"), ord("z") + 1))] = True


def _blocks(data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, is the byte the first of a unit, is it the first of a code point) of each block."""
    buffer, in_word = np.frombuffer(data, np.uint8), False
    for at in range(0, len(buffer), BLOCK):
        part = buffer[at:at + BLOCK]
        letter = _LETTER[part]
        after = np.concatenate([[in_word], letter[:-1]])
        point = (part & 0xC0) != 0x80
        yield at, point & ~(letter & after), point
        in_word = bool(letter[-1])


def count_units(data: bytes) -> int:
    return sum(int(np.count_nonzero(first)) for _, first, _ in _blocks(data))


def unit_offsets(data: bytes, low: int, high: int) -> tuple[int, int]:
    """Byte offsets of the units numbered ``low`` and ``high`` (the end if there is no such unit)."""
    found, seen = {}, 0
    for at, first, _ in _blocks(data):
        here = int(np.count_nonzero(first))
        for unit in {low, high}:
            if seen <= unit < seen + here:
                found[unit] = at + int(np.flatnonzero(first)[unit - seen])
        seen += here
    return found.get(low, len(data)), found.get(high, len(data))


def code_points(data: bytes) -> int:
    return sum(int(np.count_nonzero(point)) for _, _, point in _blocks(data))


def reverse(buffer: np.ndarray, begin: int, end: int) -> None:
    """Reverse buffer[begin:end] in place, swapping blocks from both ends."""
    while end - begin > 1:
        n = min(BLOCK, (end - begin) // 2)
        left = buffer[begin:begin + n].copy()
        buffer[begin:begin + n] = buffer[end - n:end][::-1]
        buffer[end - n:end] = left[::-1]
        begin, end = begin + n, end - n


def exchange(buffer: np.ndarray, begin: int, middle: int, end: int) -> None:
    """Exchange buffer[begin:middle] and buffer[middle:end] in place by three reversals."""
    reverse(buffer, begin, middle)
    reverse(buffer, middle, end)
    reverse(buffer, begin, end)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def form_of(text: bytes, h: list[int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> str:
    if not text or h[2] % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return "plain"
    return "spm" if h[3] % 100 < spm_percent else "psm"


def transform(text: bytes, low: int, high: int, form: str) -> bytearray:
    """The text with sentinels, its segments (cut at the byte offsets ``low`` and ``high``) in the order of the form."""
    out = bytearray(text)
    if form == "plain":
        return out
    out[high:high] = SUFFIX                               # from the back, so that offsets stay valid
    out[low:low] = MIDDLE
    out[:0] = PREFIX
    middle, suffix = low + _WIDTH, high + 2 * _WIDTH
    exchange(np.frombuffer(out, np.uint8), middle if form == "psm" else 0, suffix, len(out))
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The exact text of an output, by the inverse rotation."""
    out = bytearray(output)
    if form == "plain":
        return out
    moved = out.find(MIDDLE if form == "psm" else PREFIX)  # the segments that were exchanged: before and after it
    begin = out.find(SUFFIX)
    exchange(np.frombuffer(out, np.uint8), begin, moved, len(out))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.find(mark)
        del out[at:at + _WIDTH]
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("output", pa.binary())])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per document; ``output`` in UTF-8."""
    def rotate(batches):
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text, h = value.as_py(), draws(doc_id, seed)
                n, form = count_units(text), form_of(text, h, fim_percent, spm_percent)
                cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                low, high = unit_offsets(text, *cuts) if form != "plain" else (0, 0)
                chars = (None, None) if form == "plain" else (code_points(text[:low]), code_points(text[low:high]))
                out = bytes(transform(text, low, high, form))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((doc_id, n, form, *chars, out), RESULT)], schema=RESULT)

    return _rows(docs, id_col, text_col).mapInArrow(
        tidy(rotate), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the column ``restored``: the text rebuilt from output and form alone."""
    def back(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = bytes(restore(row.column("output")[0].as_py(), row.column("form")[0].as_py()))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.binary())], [*row.schema.names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields)
    return outputs.mapInArrow(tidy(back), f"{schema}, restored binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))


def fim_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), one row per document."""
    return restored(fill_in_middle(docs, **options)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))
