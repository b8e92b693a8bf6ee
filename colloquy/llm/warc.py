"""WARC archives: a writer with revisit records, and a sequential reader.

One gzip member per record. The reader decompresses incrementally, frames each
record by its Content-Length and verifies block and payload digests; it holds
one record at a time. Archives go to the shared folder; the list of those that
a successful task wrote is itself a table, so files of lost attempts are never
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_group, new_path, table

#: A new archive is begun when the current one has this many bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
_ID = "urn:x-page:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_DATE = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record (not yet compressed).

    A revisit holds the HTTP header only, which keeps the payload's length;
    its payload digest is that of the full payload. A null url gives a record
    without target, a null page_id an identifier of its own.
    """
    name = f"{_ID}{page_id}" if page_id is not None else f"{_ID}none:{uuid.uuid4()}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one after the other."""
    z, parts, pending = zlib.decompressobj(31), [], b""
    while True:
        data = pending or stream.read(READ_BYTES)
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(z.decompress(data))
        pending = b""
        if z.eof:
            yield b"".join(parts)
            pending, parts, z = z.unused_data, [], zlib.decompressobj(31)


def parse(data: bytes) -> dict:
    """Fields of one record; raises ValueError where framing or digests fail."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: length doesn't fit")
    if "sha1:" + digest(block) != fields["warc-block-digest"]:
        raise ValueError(f"{fields['warc-record-id']}: block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    kind = fields["warc-type"]
    if kind == "response" and (said != len(payload) or "sha1:" + digest(payload) != fields["warc-payload-digest"]):
        raise ValueError(f"{fields['warc-record-id']}: payload digest differs")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(rf"<{_ID}(-?\d+)>", x)) else None
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": said,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": number(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def _writer(folder: str, level: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, path, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, first_id, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"  # attempts never share a file
                    out, path, size, count = store.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                data = member(record(page_id, url, (html or "").encode(), first_id, revisit), level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "bytes", "records"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as stream:
                rows: list[dict] = []
                for data in members(stream):
                    r = parse(data)
                    del r["payload"]
                    rows.append(r)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); path, bytes, records of each archive.

    Null html is an empty payload. Of equal payloads of at least
    ``min_revisit_bytes`` bytes, the smallest page_id is the response and the
    others are revisits; rows that repeat that page_id are responses too, and
    so are rows without an id, which nothing can refer to, in a group without
    any. Extra columns are ignored.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("key"))
    grouped = first_of_group(keyed, "key", "page_id")
    revisit = (F.octet_length("html") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    folder = new_path(spark, "warc")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    rows = grouped.select("page_id", "url", "html", "first_id", revisit.alias("revisit"))
    return table(rows.mapInArrow(_writer(folder, level, archive_bytes), "path string, bytes long, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record.

    ``archives`` has a path column; no archive gives no row. A record that
    doesn't fit its framing or digests raises.
    """
    n = max(1, archives.count())
    paths = archives.select("path").repartition(n)
    return paths.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
