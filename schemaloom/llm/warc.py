"""WARC archives: one gzip member per record, and a reader that goes through them in sequence.

Writing. Records with equal payloads of `REVISIT_BYTES` or more are written once as a response, the one with the
smallest page_id; the others revisit it. Which payloads repeat is one aggregation over digests; the pages are joined
with the repeated digests only. An archive is a row (path, content) of about `ARCHIVE_BYTES`, the content being the
bytes of a .warc.gz file: Spark's writers reach every store that executors share. `read` takes the same two columns
from such a folder or from spark.read.format("binaryFile") over files.

Reading. A member is decompressed piece by piece; the header ends at the first empty line, the block has as many bytes
as Content-Length says, and both digests are verified. A record that is cut off, framed wrongly or altered gives a
row with `error`, and reading goes on at the next member.

Defined results: null html is an empty payload; a null url is an empty one, white space in a url is percent-encoded; a
null page_id is written as an empty one, never refers others to itself while another page has an id, and comes back
null; rows that share the smallest page_id of a payload are all responses; an empty table gives no records; extra
columns are left alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.tables import pieces
from schemaloom.session import cut

REVISIT_BYTES = 100
ARCHIVE_BYTES = 4 << 20
CHUNK = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FIELDS = (
    "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary, error string"
)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One gzip member with a response, or with a revisit of page refers_to."""
    digest, revisit = hashlib.sha256(payload).hexdigest(), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": SAME_PAYLOAD}
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return gzip.compress(lines + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class Broken(Exception):
    """A record that can't be read."""


class Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, content: memoryview, start: int):
        self.content, self.at, self.inflate, self.held = content, start, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Decompresses a piece; false at the member's end."""
        if self.inflate.eof:
            return False
        piece = self.content[self.at : self.at + CHUNK]
        if not piece:
            raise Broken("the member is cut off")
        try:
            self.held += self.inflate.decompress(piece)
        except zlib.error as problem:
            raise Broken(f"the member can't be decompressed: {problem}") from None
        self.at += len(piece) - len(self.inflate.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        while (end := self.held.find(mark)) < 0:
            if not self.more():
                raise Broken("the header has no end")
        out, self.held = self.held[:end], self.held[end + len(mark) :]
        return out

    def take(self, size: int) -> bytes:
        parts, got = [], 0
        while True:
            part, self.held = self.held[: size - got], self.held[size - got :]
            parts.append(part)
            got += len(part)
            if got == size:
                return b"".join(parts)
            if not self.held and not self.more():
                raise Broken("the block is shorter than its Content-Length")

    def close(self) -> int:
        """Where the next member begins."""
        if self.take(4) != b"\r\n\r\n":
            raise Broken("no empty lines after the block")
        while self.more():
            pass
        if self.held:
            raise Broken("the member holds more than one record")
        return self.at


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _sha256(text: str) -> bytes:
    """Bytes of a digest field in hexadecimal or base 32."""
    kind, _, value = text.partition(":")
    if kind.lower() != "sha256":
        raise Broken(f"unknown digest {kind}")
    try:
        return bytes.fromhex(value) if len(value) == 64 else base64.b32decode(value)
    except ValueError:
        raise Broken("a digest can't be read") from None


def _one(member: Member) -> tuple[dict | None, int]:
    head = member.until(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise Broken("no WARC header")
    fields = _fields(head)
    if not fields.get("content-length", "").isdecimal():
        raise Broken("no Content-Length")
    block = member.take(int(fields["content-length"]))
    after, kind = member.close(), fields.get("warc-type")
    if (told := fields.get("warc-block-digest")) and _sha256(told) != hashlib.sha256(block).digest():
        raise Broken("the block digest differs")
    if kind not in ("response", "revisit"):
        return None, after
    http, gap, payload = block.partition(b"\r\n\r\n")
    size, digest = _fields(http).get("content-length", ""), fields.get("warc-payload-digest", "")
    if not gap or not digest:
        raise Broken("no HTTP header or no payload digest")
    if kind == "response" and hashlib.sha256(payload).digest() != _sha256(digest):
        raise Broken("the payload digest differs")
    if kind == "revisit" and not size.isdecimal():
        raise Broken("a revisit without the length of its payload")
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "record_type": kind,
        "url": fields.get("warc-target-uri"),
        "payload_bytes": len(payload) if kind == "response" else int(size),
        "payload_digest": _sha256(digest).hex(),
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }, after


def records(content: bytes) -> Iterator[dict]:
    """The responses and revisits of an archive in sequence; a row with `error` for each that can't be read."""
    view, at = memoryview(content), 0
    while at < len(content):
        try:
            row, at = _one(Member(view, at))
            if row:
                yield row
        except Broken as problem:
            yield {"error": str(problem)}
            at = content.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return


def write(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """path, content of archives over pages (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    made = pages.select("page_id", "url", html.alias("payload"))
    digest = F.when(F.octet_length("payload") >= revisit_bytes, F.sha2("payload", 256)).alias("digest")
    firsts = made.select("page_id", digest).where("digest is not null").groupBy("digest")
    firsts = cut(firsts.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    joined = made.withColumn("digest", digest).join(firsts, "digest", "left")
    rows = joined.select("page_id", "url", "payload", refers_to.alias("refers_to"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            path = f"pages-{task:06d}-{n:06d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b"".join(held)], pa.binary())], ["path", "content"])

        for whole in batches:
            for batch in pieces(whole, "payload"):
                for row in batch.to_pylist():
                    made = record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                    if held and size + len(made) > archive_bytes:
                        yield flush()
                        n, held, size = n + 1, [], 0
                    held.append(made)
                    size += len(made)
        if held:
            yield flush()

    return rows.mapInArrow(each, "path string, content binary")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (path, content)."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in FIELDS.split(", "))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in records(content.as_py() or b""):
                    held.append(row)
                    size += len(row.get("payload") or b"")
                    if size > ARCHIVE_BYTES or len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return archives.select("content").mapInArrow(each, FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to a new shared folder and reads their records back."""
    return read(cut(write(pages)))
