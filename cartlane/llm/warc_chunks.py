"""WARC archives as a chunked record table.

A record is a run of rows (record, chunk, data, crc32): the bytes of the data in chunk order are the record as it
stands in a WARC/1.1 file, and the rows of an archive in (record, chunk) order are the file. A payload larger than
``CHUNK`` leaves as several rows, so neither side builds a whole record: the writer cuts views of the payload, the
reader keeps a header, two running digests and one chunk. ``crc32`` runs over the record's bytes so far, so a damaged or missing chunk is
noticed where it is; the payload's SHA-1 is carried the same way and compared with the header at the record's end.

Records of equal payloads (by SHA-256 and length): the one with the largest id is a response, the others are
revisits of it without a payload. Owners are found on digests alone, with map-side maxima; a hot group's owner is
broadcast, so its rows stay spread.

Archives are Parquet tables in the session's shared folder, written by Spark's own committer, so a lost executor
leaves no half archive; ``export`` turns the rows into the bytes of a ``.warc`` file.

Defined cases: a null payload counts as empty, and empty payloads are equal to each other; a null id is written
without the id's header and read back as null (its group's owner only where all ids are null); a null or odd URL is
left out or percent-encoded; rows that repeat the owner's id are all responses; an empty table gives an empty
archive; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import batches, left_join_hot, payload, written

#: Bytes of record that a row holds at most.
CHUNK = 1 << 16
#: Pages carry no date of capture; records get this one.
DATE = "2000-01-01T00:00:00Z"

# --- fixed values of the WARC/1.1 format ------------------------------------
VERSION = "WARC/1.1"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ---------------------------------------------------------------------------
CHUNKS = pa.schema([("record", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("crc32", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record_head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None,
                revisit: bool) -> bytes:
    """All of a record before its payload: WARC header and HTTP header. Fields of our own begin with ``X-``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_uri(page_id),
              "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}",
              "Content-Type": "application/http; msgtype=response",
              "Content-Length": len(http) + (0 if revisit else size), "X-Payload-Length": size}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if page_id is not None:
        fields["X-Page-ID"] = page_id
    if revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_uri(refers_to),
                   "X-Refers-To-Page-ID": "" if refers_to is None else refers_to}
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields.items())]).encode() + END + http


def chunk_rows(record: int, parts: list, size: int) -> Iterator[tuple]:
    """Rows of at most ``size`` bytes from the parts of a record in order; ``crc32`` runs on from row to row."""
    held, room, number, running = [], size, 0, 0
    for part in map(memoryview, parts):
        while len(part):
            piece = part[:room]
            held.append(piece)
            part, room = part[len(piece):], room - len(piece)
            if not room:
                data = b"".join(held)
                running = zlib.crc32(data, running)
                yield record, number, data, running
                held, room, number = [], size, number + 1
    if held:
        data = b"".join(held)
        yield record, number, data, zlib.crc32(data, running)


def writer(chunk: int):
    """For mapInArrow over (page_id, url, payload, owner, n): the rows of the records."""

    def rows(source):
        record = TaskContext.get().partitionId() << 33
        for batch in source:
            ids, urls, owners, sizes = (batch.column(c).to_pylist() for c in (0, 1, 3, 4))
            for i, url, owner, n, value in zip(ids, urls, owners, sizes, batch.column(2), strict=True):
                data = value.as_buffer()
                revisit = n is not None and i != owner
                digest = base32_sha1(hashlib.sha1(data).digest())
                parts = [record_head(i, url, data.size, digest, owner, revisit), END if revisit else data, b"" if revisit else END]
                yield from chunk_rows(record, parts, chunk)
                record += 1

    return lambda source: batches(rows(source), CHUNKS, weigh=lambda r: len(r[2]))


class RecordReader:
    """Takes the chunks of one record in order; ``finish`` gives the record's row or raises ``ValueError``."""

    def __init__(self):
        self.head, self.fields, self.left = bytearray(), None, 0
        self.chunks, self.crc, self.tail = 0, 0, b""
        self.sha1, self.size = hashlib.sha1(), 0

    def feed(self, number: int, data: bytes, crc: int) -> None:
        self.crc = zlib.crc32(data, self.crc)
        if number != self.chunks or crc != self.crc:
            raise ValueError(f"chunk {number} is damaged or out of order")
        self.chunks += 1
        if self.fields is None:
            # The header is as long as its URL; its end is looked for in what is new.
            searched = max(len(self.head) - len(END), 0)
            self.head += data
            if self.head.find(END, searched) < 0:
                return
            warc, found, rest = bytes(self.head).partition(END)
            http, found_http, body = rest.partition(END)
            if not found_http:
                return
            lines = warc.decode().split("\r\n")
            if lines[0] != VERSION:
                raise ValueError(f"not a WARC record: {lines[0]!r}")
            self.fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            self.left = int(self.fields["content-length"]) - len(http) - len(END)
            self.head, data = bytearray(), body
        part = memoryview(data)[:self.left]
        self.sha1.update(part)
        self.size, self.left = self.size + len(part), self.left - len(part)
        self.tail += data[len(part):]

    def finish(self) -> tuple:
        f = self.fields
        if f is None or self.left or self.tail != END:
            raise ValueError("a record is cut off")
        digest, revisit = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"] == "revisit"
        if not revisit and (base32_sha1(self.sha1.digest()) != digest or self.size != int(f["x-payload-length"])):
            raise ValueError("a payload does not have its digest")
        number = lambda k: int(f[k]) if f.get(k) else None
        return (number("x-page-id"), int(f["x-payload-length"]), digest, f["warc-type"],
                number("x-refers-to-page-id") if revisit else None)


def read_rows(rows) -> Iterator[tuple]:
    """Records of (record, chunk, data, crc32) rows that are sorted by record and chunk."""
    current, reader = None, RecordReader()
    for record, number, data, crc in rows:
        if record != current:
            if current is not None:
                yield reader.finish()
            current, reader = record, RecordReader()
        reader.feed(number, data, crc)
    if current is not None:
        yield reader.finish()


def _reading(source):
    flat = (row for batch in source for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                   (v.as_py() for v in batch.column(2)), batch.column(3).to_pylist(),
                                                   strict=True))
    return batches(read_rows(flat), RECORDS)


def write_archive(pages: DataFrame, chunk: int = CHUNK, page_id: str = "page_id", url: str = "url",
                  html: str = "html") -> DataFrame:
    """Write one record per row and return the archive's chunk table (record, chunk, data, crc32)."""
    digest = F.concat_ws(":", F.length(payload(html)), F.sha2(payload(html), 256))
    bare = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload(html).alias("payload"),
                        digest.alias("digest"))
    owners = bare.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = left_join_hot(bare, written(owners, "owners"), "digest", "n")
    rows = found.select("page_id", "url", "payload", "owner", "n")
    return written(rows.mapInArrow(writer(chunk), "record long, chunk int, data binary, crc32 long"), "archive")


def read_archive(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to. Chunks
    of one record may lie in several files or splits, so rows are dealt by record and sorted before they stream."""
    dealt = chunks.repartition("record").sortWithinPartitions("record", "chunk")
    return dealt.mapInArrow(_reading, RECORDS_DDL)


def export(chunks: DataFrame, write) -> int:
    """Stream an archive's bytes in order to ``write`` (a ``.warc`` file's), chunk by chunk; returns the bytes."""
    total = 0
    for row in chunks.orderBy("record", "chunk").select("data").toLocalIterator():
        write(bytes(row[0]))
        total += len(row[0])
    return total


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, then read the archive back."""
    return read_archive(write_archive(pages, CHUNK, page_id, url, html))
