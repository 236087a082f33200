"""WARC archives with a two-level capture index.

Writing: one gzip member per record, in files Spark's text writer commits (so
a lost executor leaves no half archive). The writer's line separator is an
empty gzip member, so every file is a plain multi-member ``.warc.gz`` stream.
The first record (smallest id) of each payload is a ``response``; later ones
are ``revisit`` records without payload.

Index: one line per record with its reversed-host URL key, file, offset and
length. Lines are range-sorted over the cluster and packed into compressed
blocks; the sparse directory keeps one bounded key per block. The block length
grows with the archive so that the directory never has more than
``MOST_BLOCKS`` keys per index (plus one block per range), which bounds its
broadcast. A lookup searches the directory by bisection, opens only the blocks
found, and then reads only the records' byte ranges of the archives.

Defined results: null html is an empty payload; a null url has the empty key;
rows with the smallest id of a payload are responses even if the row is
repeated; if all ids of a payload are null, all are responses; payloads under
``min_payload`` bytes are always responses; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attach, table, tidy, utf8

ARCHIVE_BYTES = 16 << 20
LINES_PER_BLOCK, MOST_BLOCKS, KEY_CHARS = 3000, 65_536, 200
GAP, READ_BYTES = 4096, 1 << 20     # ranges that are read together
EMPTY_MEMBER = zlib.compress(b"", 9, wbits=31)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = ("archive string, record binary")
CAPTURE = "key string, file string, offset long, length long"
PARSED = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 5 hex digits are 4 base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """Reversed-host key: com,example,blog)/path?query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    block = b"" if refers_to is not None else HTTP_HEAD % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
        head.append("X-Target-JSON: " + json.dumps(url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, filled = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        names, records = [], []
        for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
            data = zlib.compress(_record(*row), 6, wbits=31)
            if filled and filled + len(data) > ARCHIVE_BYTES:
                seq, filled = seq + 1, 0
            filled += len(data) + len(EMPTY_MEMBER)
            names.append(f"{part:06d}-{seq:05d}")
            records.append(data)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.binary())],
                                         ["archive", "record"])


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> None:
    """Write every page as a WARC record below ``path`` (``archive=*/part-*``)."""
    payload = utf8(F.col(html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    narrow = rows.select("page_id", "same", F.octet_length("payload").alias("n"))
    firsts = (narrow.where(F.col("n") >= min_payload).groupBy("same")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1 and first_id is not null"))
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("pid")
    revisits = (attach(narrow.select("page_id", "same"), firsts, "same", "copies", pages.count())
                .where(~F.col("page_id").eqNullSafe(F.col("first_id")))
                .select(pid, "same", F.col("first_id").alias("refers_to")).distinct())
    out = (rows.select("*", pid, base32_sha1(F.col("payload")).alias("digest"))
           .join(revisits, ["pid", "same"], "left")
           .select("page_id", "url", "payload", "digest", "refers_to"))
    (out.mapInArrow(tidy(_write_batches), RECORD)
     .select("archive", F.col("record").cast("string").alias("value"))
     .write.partitionBy("archive").option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path))


def _members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each non-empty gzip member."""
    at, view = 0, memoryview(content)
    while at < len(view):
        member, data, end = zlib.decompressobj(wbits=31), [], at
        while not member.eof:
            chunk = view[end:end + 65536]
            if not len(chunk):
                raise ValueError("truncated archive")
            data.append(member.decompress(chunk))
            end += len(chunk) - len(member.unused_data)
        whole = b"".join(data)
        if whole:
            yield at, end - at, whole
        at = end


def _parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    field = dict(line.split(": ", 1) for line in lines[1:])
    number = lambda urn: int(n) if (n := urn[len("<urn:page:"):-1]) else None
    length = int(field["Content-Length"])
    if len(rest) != length + 4:
        raise ValueError("record length does not match its header")
    digest, size, payload = field["WARC-Payload-Digest"].removeprefix("sha1:"), int(field["X-Payload-Length"]), None
    if field["WARC-Type"] == "response":
        payload = rest[:length].partition(b"\r\n\r\n")[2]
        read = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (read, len(payload)) != (digest, size):
            raise ValueError("payload does not match its digest")
    return {"page_id": number(field["WARC-Record-ID"]),
            "url": json.loads(field["X-Target-JSON"]) if "X-Target-JSON" in field else None,
            "record_type": field["WARC-Type"],
            "refers_to": number(field["WARC-Refers-To"]) if "WARC-Refers-To" in field else None,
            "payload_bytes": size, "payload_digest": digest, "payload": payload}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split(" ") for c in ddl.split(","))])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
            .load(path).select(F.col("path").alias("file"), "content"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One index line (key, file, offset, length) per record found in the archives."""
    schema = _schema(CAPTURE)

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                lines = [{"key": url_key(_parse(data)["url"]), "file": file, "offset": at, "length": n}
                         for at, n, data in _members(content)]
                yield pa.RecordBatch.from_pylist(lines, schema)

    return _files(spark, path).mapInArrow(tidy(scan), CAPTURE)


def build_index(lines: DataFrame, total: int) -> DataFrame:
    """(block, first_key, lines): compressed blocks of sorted index lines."""
    per_block = max(LINES_PER_BLOCK, -(-total // MOST_BLOCKS))

    def pack(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def block(rows):
            return pa.RecordBatch.from_pylist(
                [{"block": (part << 32) + seq, "first_key": rows[0][0],
                  "lines": zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), 6)}],
                pa.schema([("block", pa.int64()), ("first_key", pa.string()), ("lines", pa.binary())]))

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")))
            while len(held) >= per_block:
                yield block(held[:per_block])
                held, seq = held[per_block:], seq + 1
        if held:
            yield block(held)

    order = ["key", "file", "offset"]
    return (lines.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(tidy(pack), "block long, first_key string, lines binary"))


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Index lines of the given URL keys (column ``key``)."""
    spark = keys.sparkSession
    directory = sorted((r["k"], r["block"]) for r in index.select(
        F.substring("first_key", 1, KEY_CHARS).alias("k"), "block").collect())
    shared = spark.sparkContext.broadcast(([k for k, _ in directory], [b for _, b in directory]))

    def find(batches):
        firsts, blocks = shared.value
        for batch in batches:
            found, wanted = [], []
            for key in batch.column("key").to_pylist():
                short = key[:KEY_CHARS]
                span = blocks[max(0, bisect_left(firsts, short) - 1):bisect_right(firsts, short)]
                found += span
                wanted += [key] * len(span)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(wanted, pa.string())],
                                             ["block", "key"])

    def open_blocks(batches):
        schema = _schema(CAPTURE)
        for batch in batches:
            for lines, wanted in zip(batch.column("lines").to_pylist(), batch.column("wanted").to_pylist()):
                wanted = set(wanted)
                rows = [r for r in map(json.loads, zlib.decompress(lines).split(b"\n")) if r[0] in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    wanted = (keys.select("key").distinct().mapInArrow(tidy(find), "block long, key string")
              .groupBy("block").agg(F.collect_set("key").alias("wanted")))
    return index.join(wanted, "block").select("lines", "wanted").mapInArrow(tidy(open_blocks), CAPTURE)


def _ranged(path: str) -> bool:
    """Whether tasks can open files of this path's store themselves and read byte ranges."""
    try:
        pafs.FileSystem.from_uri(_uri(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _uri(path: str) -> str:
    """``file:/x``, as Spark names local files, is ``file:///x`` elsewhere."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def read_ranges(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """Parsed records at the lines' byte ranges (an archive's size bounds its list of ranges).

    A task opens the archive and reads the wanted ranges only; neighbouring ranges are one read. In a store
    that only Spark reads, whole archives (``ARCHIVE_BYTES`` each) are read and cut.
    """
    schema = _schema(PARSED)

    def read(batches):
        for batch in batches:
            for file, ranges in zip(batch.column("file").to_pylist(), batch.column("ranges").to_pylist()):
                store, name = pafs.FileSystem.from_uri(_uri(file))
                with store.open_input_file(name) as archive:
                    for first, size, cuts in _joined(sorted((r["offset"], r["length"]) for r in ranges)):
                        content = archive.read_at(size, first)
                        rows = [_parse(zlib.decompress(content[at - first:at - first + n], wbits=31)) for at, n in cuts]
                        yield pa.RecordBatch.from_pylist(rows, schema)

    def cut(batches):
        for batch in batches:
            for content, ranges in zip(batch.column("content").to_pylist(), batch.column("ranges").to_pylist()):
                rows = [_parse(zlib.decompress(content[r["offset"]:r["offset"] + r["length"]], wbits=31))
                        for r in ranges]
                yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = lines.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    if _ranged(path):
        return ranges.mapInArrow(tidy(read), PARSED)
    return _files(spark, path).join(ranges, "file").select("content", "ranges").mapInArrow(tidy(cut), PARSED)


def _joined(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, bytes, ranges) of the reads: ranges at most ``GAP`` bytes apart, up to ``READ_BYTES`` together."""
    held: list[tuple[int, int]] = []
    for at, n in ranges:
        if held and (at - sum(held[-1]) > GAP or at + n - held[0][0] > READ_BYTES):
            yield held[0][0], sum(held[-1]) - held[0][0], held
            held = []
        held.append((at, n))
    if held:
        yield held[0][0], sum(held[-1]) - held[0][0], held


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write all pages, index the archives, and read every page back through the index."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = f"{scratch.base}/archives"
    write_archives(pages, path, min_payload)
    if not pages.take(1):
        return spark.createDataFrame([], PARSED)
    index = scratch.write(build_index(captures(spark, path), pages.count()), "index")

    @F.pandas_udf("string")
    def keyed(urls):
        return urls.map(url_key)

    keys = pages.select(keyed(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("key"))
    return read_ranges(spark, path, lookup(keys, index))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
