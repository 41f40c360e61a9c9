"""WARC archives: a deduplicating writer and a splittable reader.

Each record is a gzip member of its own.  Reading tasks get byte ranges, scan
them for the gzip magic, take a candidate for a member only if its header
decodes and its data begins with a WARC version, and own the records that
start inside their range, to wherever those end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, check_columns, dealt, map_arrow

MAGIC = b"\x1f\x8b\x08"
#: A writer begins another archive beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive that a reading task scans.
RANGE_BYTES = 8 << 20
WINDOW = 1 << 18
URN = "urn:lattiq:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A record as a gzip member; a revisit keeps the HTTP header but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


class Window:
    """Bytes of a file from anywhere, read ahead in windows."""

    def __init__(self, path: str):
        fs, p = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(p)
        self.size = self.file.size()
        self.base, self.held = 0, b""

    def at(self, offset: int, n: int = 1) -> memoryview:
        """At least n bytes from offset, fewer only at the end of the file."""
        if offset < self.base or offset + n > self.base + len(self.held):
            self.base, self.held = offset, self.file.read_at(min(max(n, WINDOW), max(0, self.size - offset)), offset)
        return memoryview(self.held)[offset - self.base :]


def member_at(win: Window, offset: int) -> tuple[bytes, int] | None:
    """The decoded gzip member at offset and where it ends, or None if none with a WARC record is there."""
    inflate, out, at = zlib.decompressobj(31), [], offset
    try:
        while not inflate.eof:
            chunk = win.at(at)[: 1 << 16]
            if not len(chunk):
                return None
            out.append(inflate.decompress(chunk))
            at += len(chunk)
            if len(out) == 1 and out[0][:5] != b"WARC/"[: len(out[0])]:
                return None
    except zlib.error:
        return None
    raw = b"".join(out)
    return (raw, at - len(inflate.unused_data)) if raw[:5] == b"WARC/" else None


def members(path: str, start: int, end: int):
    """(offset, decoded bytes) of the members that start in [start, end)."""
    win, pos = Window(path), start
    try:
        while pos < end:
            view = win.at(pos, min(WINDOW, end + 2 - pos))
            i = bytes(view[: end + 2 - pos]).find(MAGIC) if view[:3] != MAGIC else 0
            if i < 0:
                pos = min(pos + len(view) - 2, end) if len(view) > 2 else end
                continue
            pos += i
            if pos >= end:
                break
            if (got := member_at(win, pos)) is None:
                pos += 1
            else:
                yield pos, got[0]
                pos = got[1]
    finally:
        win.file.close()


def parse(raw: bytes) -> dict:
    """A record's headers (lower-case names), HTTP header and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": http.decode("latin-1"), "payload": payload}


def _urn(value: str | None) -> int | None:
    return int(value[len(URN) + 1 : -1]) if value and len(value) > len(URN) + 2 else None


def write_archives(pages: DataFrame, scratch: Scratch, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html; null html: empty).

    Of rows with equal payloads, that with the largest page_id is a response
    and the others are revisits of it; rows that repeat its page_id are
    responses too, and where all page_ids are null all are.  Returns the
    manifest: path, bytes, records.  A task that is run again writes under
    another name, and only names in the manifest count.
    """
    pages = check_columns(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    digest = F.unhex(F.sha2(F.encode("html", "UTF-8"), 256))
    slim = pages.select("page_id", digest.alias("digest"))
    last = scratch.cut(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "last")
    again = slim.join(last, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    again = scratch.cut(again, "again")
    rows = pages.withColumn("digest", digest)
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["_id"]) & (rows["digest"] == again["_digest"]), "left").select("page_id", "url", "html", "refers_to")
    folder = scratch.path("archives")
    fs, p = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(p, recursive=True)

    def run(batches):
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    to, p = pyarrow.fs.FileSystem.from_uri(path)
                    out = to.open_output_stream(p, compression=None)
                raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), d)) for d in done], schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return scratch.cut(map_arrow(rows, run, "path string, bytes long, records long"), "manifest")


def read_archives(manifest: DataFrame, keep_payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Reads archives back in byte ranges, dealt to tasks by the archives' bytes: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's digest is computed from the payload read and must agree with
    its header; a revisit has both from its headers.  With ``keep_payload``
    also payload (null for revisits).  Bytes that are no member with a WARC
    record are passed over.  Each record gives a row, also where records
    repeat a page_id or have none; rows are in no order, and a manifest
    without archives gives none.
    """
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n_ranges, n_bytes = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes)), F.sum("bytes")).first()
    ranges = dealt(ranges, n_ranges or 0, n_bytes or 0)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * keep_payload
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())] + [("payload", pa.binary())] * keep_payload)

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for _, raw in members(path, start, min(size, start + range_bytes)):
                    r = parse(raw)
                    f, payload = r["fields"], r["payload"]
                    digest, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
                    if kind == "response":
                        n = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: a payload of {f['warc-record-id']} does not have its digest")
                    else:
                        n = int(next(x for x in r["http"].split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
                    rows.append((_urn(f["warc-record-id"]), n, digest, kind, _urn(f.get("warc-refers-to")), f.get("warc-target-uri"), payload if kind == "response" else None))
                    held += len(payload) * keep_payload
                    if len(rows) >= 2000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], schema=schema)

    return map_arrow(ranges, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * keep_payload)
