"""WARC archives with a two-level capture index.

Tasks write records, each a gzip member of its own, into archive files in the shared folder
and return where each record lies. The index holds a line for each capture, sorted by its
reversed-host key: lines in compressed blocks, and at the end of each index file a sparse
directory with the first key of each block. A lookup bisects the index files' first keys, then
the file's directory, reads one block's byte range, bisects its lines, and reads the record's
byte range from its archive.

A task that is run again writes files of new names and returns these; what an attempt that
failed has left is never referred to.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm import common
from runfold.session import ship

BLOCK_LINES = 256
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
BROADCAST_HEADS = 100_000
CAPTURES = "key string, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """The url with its host reversed, `com,example,www)/path?query`, white space and controls escaped."""
    url = url or ""
    scheme, found, rest = url.partition("://")
    if not found:
        return "-)" + quote(url, safe="/?#&=;:@+$,!*'()%~[]")
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(quote(rest[:cut].lower(), safe=":@,").split("."))) + ")" + quote(rest[cut:], safe="/?#&=;:@+$,!*'()%~[]")


def key_of(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} {'-' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record as a gzip member: a response with its payload, or a revisit without."""
    name = "null" if page_id is None else str(page_id)
    head = [f"WARC-Record-ID: <urn:page:{name}>", "WARC-Target-URI: " + quote(url or "", safe="/?#&=;:@+$,!*'()%~[]"), "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head = ["WARC-Type: response", *head]
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
        head = ["WARC-Type: revisit", *head, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    text = "\r\n".join(["WARC/1.1", *head, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(text + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """What a record says: page_id, payload bytes, digest, type, and the page a revisit refers to; a response's payload is measured."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    page = lambda x: None if x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
    page_id, kind, digest = page(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "revisit":
        return page_id, int(fields["X-Payload-Length"]), digest, kind, page(fields["WARC-Refers-To"])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    measured = hashlib.sha1(payload).hexdigest()
    if measured != digest:
        raise ValueError(f"page {page_id}: the payload's digest is {measured}, not {digest}")
    return page_id, len(payload), measured, kind, None


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads the page with the largest id is kept, the others refer to it."""
    html = common.text_or_empty(F.col("html").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("long_enough", F.octet_length("html") >= least)
    heads = rows.where("long_enough").groupBy("digest").agg(F.max("page_id").alias("__head"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __head is not null").select(F.col("digest").alias("__digest"), "__head")
    heads = common.materialize(heads, "heads")
    few = heads.count() <= BROADCAST_HEADS
    joined = rows.join(F.broadcast(heads) if few else heads, F.col("long_enough") & (F.col("digest") == F.col("__digest")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.coalesce(F.col("page_id") == F.col("__head"), F.lit(False)), F.col("__head")).alias("refers_to"))


def open_out(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


class Reader:
    """Byte ranges of files in any store; keeps one file open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            store, path = fs.FileSystem.from_uri(name)
            self.name, self.file = name, store.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(length)

    def size(self, name: str) -> int:
        store, path = fs.FileSystem.from_uri(name)
        return store.get_file_info(path).size


def uri(folder: str) -> str:
    """A URI without an empty authority's ambiguity: `file:///x` for `file:/x` and `/x`."""
    if folder.startswith("/"):
        return "file://" + folder
    if folder.startswith("file:/") and not folder.startswith("file://"):
        return "file://" + folder[5:]
    return folder


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, html, digest, refers_to) as WARC files and return the captures (key, file, offset, length)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            got = []
            for r in batch.to_pylist():
                if out is None:
                    name, out = open_out(folder, f"{uuid.uuid4().hex}.warc.gz")
                member = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])
                out.write(member)
                got.append((key_of(r["url"], r["page_id"]), name, at, len(member)))
                at += len(member)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return common.materialize(rows.mapInArrow(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index of captures and return its files: (file, first_key), one row for each file with a line.

    A file is its compressed blocks, its directory as compressed JSON, and the directory's offset in 8 bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, first, directory, lines = None, "", 0, None, [], []

        def flush() -> None:
            nonlocal at, lines
            block = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
            out.write(block)
            directory.append((lines[0][0], at, len(block)))
            at += len(block)
            lines = []

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if out is None:
                    name, out = open_out(folder, f"{uuid.uuid4().hex}.index")
                    first = line[0]
                lines.append(line)
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.write(zlib.compress(json.dumps(directory).encode()) + struct.pack("<Q", at))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [first]})

    parts = common.shuffle_parts(captures.sparkSession)
    ordered = captures.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return common.materialize(ordered.mapInArrow(write, "file string, first_key string"), "index")


class Index:
    """Lookups in index files, given their (first_key, name) in order."""

    def __init__(self, files: list[tuple[str, str]]):
        self.firsts, self.names = [k for k, _ in files], [n for _, n in files]
        self.reader, self.directory, self.block = Reader(), ("", []), ((), [], [])

    def directory_of(self, name: str) -> list[list]:
        if self.directory[0] != name:
            size = self.reader.size(name)
            start = struct.unpack("<Q", self.reader.read(name, size - 8, 8))[0]
            self.directory = (name, json.loads(zlib.decompress(self.reader.read(name, start, size - 8 - start))))
        return self.directory[1]

    def lines_of(self, name: str, offset: int, length: int) -> tuple[list[str], list[list[str]]]:
        if self.block[0] != (name, offset):
            lines = [x.split("\t") for x in zlib.decompress(self.reader.read(name, offset, length)).decode().split("\n")]
            self.block = ((name, offset), [x[0] for x in lines], lines)
        return self.block[1:]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of each capture with ``key``."""
        for n in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            directory = self.directory_of(self.names[n])
            starts = [d[0] for d in directory]
            for _, offset, length in directory[max(0, bisect_left(starts, key) - 1) : bisect_right(starts, key)]:
                keys, lines = self.lines_of(self.names[n], offset, length)
                for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                    yield line[1], int(line[2]), int(line[3])


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, file, offset, length) of every capture of the distinct keys in ``keys`` (key)."""
    files = sorted((r.first_key, r.file) for r in index.collect())  # one row a shuffle partition at most

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(files)
        for batch in batches:
            rows = [(key, *capture) for key in batch.column("key").to_pylist() for capture in found.find(key)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "file", "offset", "length"])

    parts = common.shuffle_parts(keys.sparkSession)
    return keys.distinct().repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(search, CAPTURES)


def read_records(captures: DataFrame) -> DataFrame:
    """What the records at (file, offset, length) say, read by byte range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in common.small_batches(batches):
            places = sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            rows = [parse(reader.read(*p)) for p in places]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return captures.mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` (page_id, url, html), index the captures, look every page up again and read its record.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is
    an empty payload. Of equal payloads of at least 1000 bytes every row with the largest page_id
    is a response. Rows with a null page_id are archived and found again under their url.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = uri(common.scratch_path(spark, "warc"))
    captures = write_archives(with_revisits(pages), folder)
    index = write_index(captures, folder)
    return read_records(lookup(captures.select("key"), index))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
d AS (SELECT *, sha1(html) AS digest FROM p),
h AS (SELECT digest, max(page_id) AS head FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN h.head IS NULL OR h.head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.head <> page_id THEN h.head END AS refers_to
FROM d LEFT JOIN h ON d.digest = h.digest AND d.n >= 1000
"""
