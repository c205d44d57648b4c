"""WARC derivatives: response records become linked metadata records and plain-text conversion records."""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows
from .html_blocks import read, text_of

VERSION = "WARC/1.1"
#: Bytes of derivatives that a task gathers before it sends them on.
BATCH_BYTES = 8 << 20
#: Beginnings of the names of text encodings that are taken from a page; others are read as UTF-8.
CHARSETS = ("utf-8", "utf-16", "utf-32", "ascii", "iso8859", "cp12", "cp4", "cp8", "cp9", "koi8", "mac-", "shift", "euc", "gb", "big5", "iso2022", "tis", "hz", "johab")
Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    """sha1: and the base-32 SHA-1, as in WARC files."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    """A urn:uuid that depends on the names only, so that a task run again gives the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(names))}>"


def write_record(headers: Headers, block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_head(data: bytes) -> tuple[str, Headers, bytes]:
    """First line, headers (continued lines joined) and what follows the empty line."""
    m = re.search(rb"\r?\n\r?\n", data)
    head, rest = (data[: m.start()], data[m.end() :]) if m else (data, b"")
    first, *lines = head.decode("utf-8", "replace").splitlines() or [""]
    headers: Headers = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return first.strip(), headers, rest


def header(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def parse_record(data: bytes) -> tuple[Headers, bytes] | None:
    """Headers and block of one record, or None if it isn't one. A block that is cut off stays as it is."""
    version, headers, rest = split_head(data)
    if not version.startswith("WARC/"):
        return None
    size = length(header(headers, "Content-Length"))
    return headers, rest if size is None else rest[:size]


def length(text: str | None) -> int | None:
    """A Content-Length, or None if it isn't a number."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) <= 18 else None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """record (binary) of all WARC files at a path, plain or gzipped (one member for each record or one for all).

    Files are streamed by Spark's own reader, which cuts them before each record's first line, so none is held whole; what follows a
    record's Content-Length is dropped. A file that holds WARC records inside of a record's block yields these too.
    """

    def records(batches):
        for batch in batches:
            for piece in batch.column("value"):
                piece = piece.as_py()
                first = re.match(rb"\s*(?:WARC/1\.)?(\d[^\r\n]*\r?\n)", piece)
                if first:
                    head, gap, rest = (b"WARC/1." + first[1] + piece[first.end() :]).partition(b"\r\n\r\n")
                    size = length(next((x.split(b":", 1)[1].strip().decode("ascii", "replace") for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None))
                    yield pa.record_batch({"record": pa.array([head + gap + (rest if size is None else rest[:size])], pa.binary())})

    return spark.read.option("lineSep", "\r\nWARC/1.").text(path).select(F.col("value").cast("binary")).mapInArrow(records, "record binary")


def dechunk(body: bytes) -> bytes:
    """The body of a chunked HTTP message; what is malformed stays as it is."""
    out, at = [], 0
    while (m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r?\n").match(body, at)) is not None:
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join(out) if out else body


def payload(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and decoded body of an HTTP response."""
    status, headers, body = split_head(block)
    if not status.startswith("HTTP/"):
        return "", [], block
    if "chunked" in (header(headers, "Transfer-Encoding") or "").lower():
        body = dechunk(body)
    for coding in reversed([c.strip() for c in (header(headers, "Content-Encoding") or "").lower().split(",")]):
        body, state = unpacked(body, coding)
        if state:
            headers = [*headers, (UNPACKING, state)]
        if state.startswith("unknown"):
            break
    return status, headers, body


#: The most bytes that a body is unpacked to; what is beyond is cut off, and the metadata record says so.
MOST_BYTES = 32 << 20
#: A field added to a response's headers: how unpacking went, if not well.
UNPACKING = "X-Unpacking"


def unpacked(body: bytes, coding: str) -> tuple[bytes, str]:
    """The body without one content coding, and what went wrong: nothing, "cut", "malformed", or "unknown" for a coding that can't be read,
    of which nothing is left. A malformed body stays as it is. Never more than MOST_BYTES are made."""
    if coding in ("", "identity"):
        return body, ""
    if coding in ("gzip", "x-gzip", "deflate"):
        for window in ((31,) if coding != "deflate" else (15, -15)):  # deflate comes with zlib's frame or without
            out, rest, left = [], body, MOST_BYTES
            try:
                while rest and left > 0:  # a gzip body can have several members
                    unpack = zlib.decompressobj(window)
                    out.append(unpack.decompress(rest, left))
                    left -= len(out[-1])
                    if unpack.unconsumed_tail or not unpack.eof:
                        return b"".join(out), "cut" if unpack.unconsumed_tail else "malformed"
                    rest = unpack.unused_data if window == 31 and unpack.unused_data[:2] == b"\x1f\x8b" else b""
                return b"".join(out), "cut" if rest else ""
            except zlib.error:
                if any(out):
                    return b"".join(out), "malformed"
        return body, "malformed"
    return b"", f"unknown {coding}"


def decoded(body: bytes, content_type: str | None) -> str:
    m = re.search(r"charset=[\"']?([\w.:-]+)", content_type or "", re.I) or re.search(r"charset=[\"']?([\w.:-]+)", body[:2048].decode("ascii", "ignore"), re.I)
    try:
        name = codecs.lookup(m[1]).name if m else "utf-8"
    except (LookupError, ValueError):
        name = "utf-8"
    return body.decode(name if name.startswith(CHARSETS) else "utf-8", "replace")


#: Headers of the source that both derivatives repeat under their own names.
KEPT = ("WARC-Target-URI", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type")


def derive(headers: Headers, block: bytes) -> list[tuple[str, Headers, bytes]]:
    """The metadata and the conversion record of a response: type, headers and block of each.

    Both refer to the response by its WARC-Record-ID, URI and date, and to each other by WARC-Concurrent-To. The source's WARC
    and HTTP headers and its digests (computed where it has none) are fields of the metadata record.
    """
    status, http, body = payload(block)
    source = header(headers, "WARC-Record-ID") or record_id("response", header(headers, "WARC-Target-URI") or "", digest(block))
    uri, date = header(headers, "WARC-Target-URI") or "", header(headers, "WARC-Date") or "1970-01-01T00:00:00Z"
    kind = header(http, "Content-Type")
    block_digest = header(headers, "WARC-Block-Digest") or digest(block)
    payload_digest = header(headers, "WARC-Payload-Digest") or digest(split_head(block)[2] if status else block)
    text = decoded(body, kind)
    is_html = "html" in (kind or "").lower() or not kind and "<" in text[:1000]
    page = read(text if is_html else "")
    plain = text_of(page) if is_html else text if (kind or "text/plain").lower().startswith("text/") else ""
    links = list(dict.fromkeys(_absolute(uri, x) for x in page.links if x and not x.startswith(("#", "javascript:", "mailto:"))))
    fields = [("source-record-id", source), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest)]
    fields += [("source-status", status)] * bool(status) + [("title", page.title)] * bool(page.title)
    fields += [(f"source-warc-{k.lower().removeprefix('warc-')}", v) for k, v in headers] + [("unpacking" if k == UNPACKING else f"source-http-{k.lower()}", v) for k, v in http]
    fields += [("outlink", f"{x} L a/@href") for x in links]
    ids = {name: record_id(name, source) for name in ("metadata", "conversion")}
    out = []
    for name, other, content_type, data in (
        ("metadata", "conversion", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")),
        ("conversion", "metadata", "text/plain; charset=utf-8", plain.encode("utf-8", "surrogatepass")),
    ):
        head = [("WARC-Type", name), ("WARC-Record-ID", ids[name]), ("WARC-Date", date), ("WARC-Refers-To", source)]
        head += [("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", ids[other])]
        head += [(k, v) for k in KEPT if (v := header(headers, k))]
        head += [("Content-Type", content_type), ("WARC-Block-Digest", digest(data))]
        out.append((name, head, data))
    return out


def _absolute(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


_DERIVED = pa.schema([
    *((k, pa.string()) for k in ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "source_block_digest", "source_payload_digest", "block_digest")),
    ("content_length", pa.int64()), ("block", pa.binary()), ("record", pa.binary()),
])
_DERIVED_DDL = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in _DERIVED)


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows (metadata, conversion) for every response in records(record binary).

    Other record types, null and malformed records give none. Repeated responses give repeated rows with the same identifiers.
    `record` is the whole derivative, ready to be written; block its content. Further columns of records are dropped. Bodies are
    unpacked (gzip, deflate) up to MOST_BYTES; "unpacking" in the metadata says cut, malformed (what can't be unpacked stays as it is), or
    unknown and the coding, of which the conversion is empty. Encodings of text that aren't known are read as UTF-8. A task holds one record
    at a time with its body of at most that many bytes.
    """

    def derived(batches):
        out, size = [], 0
        for batch in batches:
            for data in batch.column("record"):
                parsed = parse_record(data.as_py()) if data.is_valid else None
                if parsed is None or (header(parsed[0], "WARC-Type") or "").lower() != "response":
                    continue
                made = derive(*parsed)
                fields = dict(line.split(": ", 1) for line in made[0][2].decode().split("\r\n")[:3])
                for name, head, block in made:
                    row = [name, *(header(head, k) for k in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Date", "Content-Type"))]
                    out.append([*row, fields["source-block-digest"], fields["source-payload-digest"], header(head, "WARC-Block-Digest"), len(block), block, write_record(head, block)])
                    size += 2 * len(block)
                if size >= BATCH_BYTES:
                    yield rows(_DERIVED, list(zip(*out)))
                    out, size = [], 0
        if out:
            yield rows(_DERIVED, list(zip(*out)))

    return records.select("record").mapInArrow(derived, _DERIVED_DDL)


def as_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """record (binary): a WARC response for every row of pages(page_id, url, html), with digests. Null html is an empty page."""

    def responses(batches):
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body = (html or "").encode("utf-8", "surrogatepass")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("page", str(page_id), url or "", digest(body)))]
                head += [("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or ""))] * bool(url) + [("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
                head += [("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))]
                out.append(write_record(head, block))
            yield pa.record_batch({"record": pa.array(out, pa.binary())})

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(responses, "record binary")
