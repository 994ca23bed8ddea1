"""WARC archives: one gzip member for each record, read back sequentially.

Writing: rows are dealt by a hash of page and payload, a partition for each archive; a task writes its archive under a
temporary name and renames it, so an attempt that is repeated leaves the same file. Reading: a task streams an
archive in pieces of 1 MB through zlib, one member after the other, takes the block by its Content-Length and
checks the digests. Memory is bounded by the largest record. Files are reached through
the file system of the folder's URI, never through a machine-local path.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, staged, text_batches

LEAST_REVISIT = 1000  # bytes; shorter payloads are always written
PIECE = 1 << 20
ROWS_AN_ARCHIVE = 4000
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class BrokenArchive(ValueError):
    """A record whose framing or digest does not hold."""


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str, payload: bytes, size: int, refers_to) -> bytes:
    """One gzip member. A revisit has the HTTP head, with the length of the payload, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", _base32(payload)),
        ("WARC-Block-Digest", _base32(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a binary stream, in order, inflated piece by piece."""
    unpacker, parts, left = zlib.decompressobj(31), [], b""
    while piece := left or stream.read(PIECE):
        parts.append(unpacker.decompress(piece))
        left = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise BrokenArchive("the last member is cut off")


def parsed(member: bytes) -> dict:
    """Headers (names in lower case), HTTP head and payload of a record; raises where it does not hold together."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise BrokenArchive("no record header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise BrokenArchive("the block is not as long as its Content-Length")
    if _base32(block) != headers["warc-block-digest"]:
        raise BrokenArchive("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    length = int(fields["content-length"])
    if headers["warc-type"] == "response" and (len(payload) != length or _base32(payload) != headers["warc-payload-digest"]):
        raise BrokenArchive("payload length or digest")
    return {"headers": headers, "payload": payload, "payload_length": length}


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, refers_to): the payloads of at least 1000 bytes that a page with a larger id has too."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    found = pages.filter(F.col("page_id").isNotNull() & (size >= LEAST_REVISIT)).select("page_id", "sha1", size.alias("size")).distinct()
    largest = found.groupBy("sha1", "size").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).filter("first < last")
    return found.join(largest, ["sha1", "size"]).filter("page_id < last").select("page_id", "sha1", F.col("last").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archives: int) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) to `folder`; (archive, records, bytes) of the files.

    Of equal payloads of at least 1000 bytes the row with the largest page_id is a response and the others
    revisit it; a row without page_id is always a response. Repeated rows are written as often as they occur.
    The rows and the list of revisits are dealt once, by page and payload, to as many partitions as there are archives:
    a partition is an archive. In its order an entry of the list comes just before the rows that it marks.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url"), F.col("html"))
    pages = pages.withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    marks = revisits(pages).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha1", "refers_to")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), "sha1", F.lit(None).cast("long").alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _folder(folder)
        files.create_dir(base, recursive=True)
        archive, n, out, mark = TaskContext.get().partitionId(), 0, None, None
        final = f"{base}/{archive:06d}.warc.gz"
        attempt = f"{final}.{uuid.uuid4().hex}"
        for batch in text_batches(batches, "html"):
            for row in batch.to_pylist():
                key = row["page_id"], row["sha1"]
                if row["html"] is None:
                    mark = key, row["refers_to"]
                    continue
                if out is None:
                    out = files.open_output_stream(attempt)
                payload = row["html"].encode()
                out.write(record(row["page_id"], row["url"], payload, len(payload), mark[1] if mark and mark[0] == key else None))
                n += 1
        if out is None:
            return
        out.close()
        files.move(attempt, final)
        yield pa.RecordBatch.from_arrays(
            [pa.array([archive], pa.int32()), pa.array([n], pa.int64()), pa.array([files.get_file_info(final).size], pa.int64())], ["archive", "records", "bytes"]
        )

    dealt = rows.unionByName(marks).repartition(archives, "page_id", "sha1")
    dealt = dealt.sortWithinPartitions("page_id", "sha1", F.col("refers_to").isNull(), "url")
    return staged(dealt.mapInArrow(run, "archive int, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record; payload is null for revisits."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def flush(rows):
        return pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _folder(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{base}/{archive:06d}.warc.gz", compression=None) as stream:
                    for member in members(stream):
                        found = parsed(member)
                        h = found["headers"]
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = h["warc-type"] == "revisit"
                        rows.append(
                            {
                                "page_id": int(h["x-page-id"]) if h["x-page-id"] else None,
                                "url": h["warc-target-uri"],
                                "record_type": h["warc-type"],
                                "refers_to": int(h["x-refers-to-page-id"]) if revisit else None,
                                "payload_bytes": found["payload_length"],
                                "payload_digest": digest,
                                "payload": None if revisit else found["payload"],
                            }
                        )
                        held += len(found["payload"])
                        if held > 8 * PIECE:
                            yield flush(rows)
                            rows, held = [], 0
                yield flush(rows)

    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back. The number of archives follows the rows."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = max(8, -(-pages.count() // ROWS_AN_ARCHIVE))
    return read_archives(write_archives(pages, folder, archives), folder)
