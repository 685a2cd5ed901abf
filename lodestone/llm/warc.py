"""Derived WARC records: responses to metadata and plain-text conversion records.

Each response gives a conversion record, its text, and a metadata record, its title, links and
headers. Both keep the target, date and digests of the response and refer to it by its record
id. Records can be written as WARC 1.1 and read again.

A record's ``headers`` are all its WARC fields that have no column of their own, under the
names that they have in the file; the values of a field that repeats are parted by line ends.
A derived record names its source's fields ``X-Source-...`` and its HTTP fields
``X-Source-HTTP-...``.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, headers map<string,string>, block binary"
NAMES = ["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "headers", "block"]
_TYPE = pa.schema([*((n, pa.string()) for n in NAMES[:8]), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!doctype[^>]*>|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)")
_BREAK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|main|pre|blockquote|title)\b[^>]*>")
_TAG = re.compile(r"(?s)<[a-zA-Z/!?][^>]*>")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title\s*>")
_LINK = re.compile(r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_CHARSET = re.compile(r"""(?i)charset\s*=\s*["']?([A-Za-z0-9._:-]+)""")


def digest(data: bytes) -> str:
    """SHA-1 as WARC writers label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An id that the same parts always give."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(page: str | None) -> str:
    """The visible text of a page: blocks on lines of their own, entities decoded."""
    body = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub(" ", page or "")))
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape(body).split("\n"))
    return "\n".join(line for line in lines if line)


def page_metadata(page: str | None) -> list[tuple[str, str]]:
    """Title and links of a page, in order."""
    title = _TITLE.search(page or "")
    out = [("title", _BLANKS.sub(" ", html.unescape(title[1]).replace("\n", " ")).strip())] if title else []
    return out + [("outlink", html.unescape(next(x for x in m if x) if any(m) else "").strip()) for m in _LINK.findall(page or "")]


def charset_of(content_type: str, payload: bytes) -> str:
    """The character set that the HTTP header names, else the page itself in its first 1024 bytes, else UTF-8."""
    named = _CHARSET.search(content_type) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return codecs.lookup(named[1]).name if named else "utf-8"
    except LookupError:
        return "utf-8"


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of an HTTP response; without a status line all is payload.

    The values of a field that repeats are parted by line ends, in order. A field's value that
    goes on over lines is put together.
    """
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("latin-1")).split("\r\n")
    fields: dict[str, list[str]] = {":status": [status]}
    for k, colon, v in (line.partition(":") for line in lines):
        if colon:
            fields.setdefault(k.strip().lower(), []).append(v.strip())
    return {k: "\n".join(v) for k, v in fields.items()}, payload


def unchunked(payload: bytes) -> bytes:
    """What a chunked transfer holds; from a chunk on that can't be read all is taken as it is."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n").match(payload, at):
        size = int(m[1], 16)
        out.append(payload[m.end() : m.end() + size])
        at = m.end() + size + 2
        if not size:
            return b"".join(out)
    return b"".join([*out, payload[at:]])


def _inflated(data: bytes, *windows: int) -> bytes | None:
    """Compressed data, whole or as far as it goes; null if it is none of the formats."""
    for bits in windows:
        machine, out, rest = zlib.decompressobj(bits), [], data
        try:
            while rest:
                out.append(machine.decompress(rest))
                rest = machine.unused_data if machine.eof and bits == 31 else b""
                machine = zlib.decompressobj(bits) if rest else machine
            return b"".join(out)
        except zlib.error:
            if any(out):
                return b"".join(out)
    return None


def content_of(http: dict[str, str], payload: bytes) -> tuple[bytes, list[str]]:
    """The payload without its transfer and content codings, and the codings that were left on.

    Chunked, gzip and deflate are undone, the last applied first; where archives have undone a
    coding already and only its name was kept, the payload is as it is.
    """
    codings = [[x for v in http.get(k, "").lower().split("\n") for y in v.split(",") if (x := y.strip())] for k in ("content-encoding", "transfer-encoding")]
    left = []
    for coding in reversed([*codings[0], *codings[1]]):
        if left:
            left.append(coding)
        elif coding == "chunked":
            payload = unchunked(payload)
        elif coding in ("gzip", "x-gzip"):
            payload = (_inflated(payload, 31) if payload.startswith(b"\x1f\x8b") else None) or payload
        elif coding == "deflate":
            payload = _inflated(payload, 15, -15) or payload
        elif coding != "identity":
            left.append(coding)
    return payload, left


def derived(response: dict) -> list[dict]:
    """The conversion and the metadata record of a response.

    The text is that of the payload without its codings; a payload under another coding than
    chunked, gzip, deflate and identity gives an empty text, and the metadata name the coding.
    The digests in a record's own fields are those of its own block and payload; those that the
    response carries, and those worked out here, are among the source's fields.
    """
    block = response.get("block") or b""
    http, payload = http_parts(block)
    content, left = content_of(http, payload)
    page = "" if left else content.decode(charset_of(http.get("content-type", ""), content), "replace")
    given = {"Block-Digest": response.get("block_digest"), "Payload-Digest": response.get("payload_digest"), "Block-SHA1": digest(block), "Payload-SHA1": digest(payload), "Content-SHA1": digest(content) if content != payload else None, "Coding": ", ".join(left) or None}
    source = {f"X-Source-{k}": v for k, v in dict(response.get("headers") or ()).items()} | {f"X-Source-{k}": v for k, v in given.items() if v is not None} | {f"X-Source-HTTP-{k.lstrip(':')}": v for k, v in http.items()}
    shared = {"refers_to": response["record_id"], "target_uri": response.get("target_uri"), "date": response.get("date")}
    fields = [*page_metadata(page), *((k.removeprefix("X-").lower(), x) for k, v in sorted(source.items()) for x in v.split("\n"))]
    blocks = {"conversion": ("text/plain; charset=utf-8", plain_text(page)), "metadata": ("application/warc-fields", "".join(f"{k}: {_BLANKS.sub(' ', v.replace(chr(10), ' '))}\r\n" for k, v in fields))}
    out = []
    for kind, (content_type, text) in blocks.items():
        data = text.encode("utf-8", "replace")
        out.append({"warc_type": kind, "record_id": record_id(kind, response["record_id"]), "content_type": content_type, "block": data, "block_digest": digest(data), "payload_digest": digest(data), "headers": source} | shared)
    return out


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id") -> DataFrame:
    """Response records of stored pages (id, url, html).

    Null pages are empty. A record's id is made of the page's id, address and content, so
    pages without id or address have ids of their own and a page that repeats has one id.
    Other columns aren't read; an empty table gives no record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (page or "").encode("utf-8", "replace")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                rows.append({"source_id": id_, "warc_type": "response", "record_id": record_id(repr(id_), repr(url), digest(payload)), "target_uri": url, "date": date, "content_type": "application/http; msgtype=response", "payload_digest": digest(payload), "block_digest": digest(block), "headers": {}, "block": block})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("source_id", pa.int64()), *_TYPE]))

    given = pages.select(F.col(id_col).cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return given.mapInArrow(run, "source_id long, " + RECORD)


def derivatives(records: DataFrame, carry: str | None = "source_id") -> DataFrame:
    """Two records for each response of ``records`` that has an id; other records give none. ``carry`` names a long column kept.

    Null blocks are empty; records that repeat give repeated records; whole pages are read.
    """
    lead = [(carry, pa.int64())] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                rows = [d | {n: r[n] for n, _ in lead} for r in whole.slice(at, 200).to_pylist() for d in derived(r)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([*lead, *_TYPE]))

    wanted = records.where("warc_type = 'response' AND record_id IS NOT NULL").select(*[n for n, _ in lead], *NAMES)
    return wanted.mapInArrow(run, (f"`{carry}` long, " if carry else "") + RECORD)


#: What each record begins with, up to the digit of its version.
_MARK = b"WARC/1."
_LINE = re.compile(r"[\r\n]+")
_FIELDS = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "Content-Type": "content_type", "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest"}


def to_warc(record: dict) -> bytes:
    """A record as WARC 1.1, its block byte for byte."""
    block = record.get("block") or b""
    named = [(k, record[c]) for k, c in _FIELDS.items() if record.get(c) is not None]
    extra = [(k, x) for k, v in sorted(dict(record.get("headers") or ()).items()) for x in (v or "").split("\n")]
    lines = "".join(f"{k}: {_LINE.sub(' ', str(v))}\r\n" for k, v in [*named, *extra, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_of(part: bytes) -> tuple[dict, int] | None:
    """(record, bytes that its block lacks) of what follows a version mark; null if that is no record.

    Names of fields go without regard to case. A block that is shorter than stated is kept as
    it is and the record marked as truncated, if it isn't already.
    """
    head, found, rest = part.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not re.fullmatch("[0-9]", lines[0]):
        return None
    fields: dict[str, list[str]] = {}
    for name, colon, value in (line.partition(":") for line in lines[1:]):
        if colon:
            fields.setdefault(name.strip(), []).append(value.strip())
    known = {k.lower(): c for k, c in _FIELDS.items()}
    out: dict = dict.fromkeys(known.values()) | {"headers": {}}
    size = None
    for name, values in fields.items():
        if name.lower() in known:
            out[known[name.lower()]] = values[0]
        elif name.lower() == "content-length":
            size = int(values[0]) if values[0].isdigit() else None
        else:
            out["headers"][name] = "\n".join(values)
    if out["warc_type"] is None:
        return None
    lacks = max(0, (size or 0) - len(rest))
    if lacks:
        out["headers"].setdefault("WARC-Truncated", "unspecified")
    return out | {"block": rest[:size] if size is not None else rest.removesuffix(b"\r\n\r\n")}, lacks


def records_in(parts: Iterator[bytes]) -> Iterator[dict]:
    """The records of a file given as what lies between its version marks, in order.

    A mark inside a block parts the block; it is put together again by the block's stated length.
    """
    held, lacks = b"", 0
    for part in parts:
        if held and (not lacks or len(part) + len(_MARK) > lacks + 4):
            yield record_of(held)[0]
            held = b""
        whole = held + _MARK + part if held else part
        found = record_of(whole)
        held, lacks = (whole, found[1]) if found else (held, lacks)
    if held:
        yield record_of(held)[0]


def read_warc(spark, path: str) -> DataFrame:
    """Records of uncompressed or gzip-compressed WARC files, by Spark's own reader.

    Files are parted at version marks, so tasks share an uncompressed file and no task holds
    more of a file than a batch of records. A record whose block holds a mark and that lies
    across the border of two tasks' parts comes out truncated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((place, part) for batch in batches for place, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        held: list[dict] = []
        for _, of_file in itertools.groupby(rows, lambda r: r[0]):
            for record in records_in(part for _, part in of_file):
                held.append(record)
                if len(held) == 200:
                    yield pa.RecordBatch.from_pylist(held, _TYPE)
                    held = []
        yield pa.RecordBatch.from_pylist(held, _TYPE)

    place = F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start").alias("place")
    parts = spark.read.option("lineSep", _MARK.decode()).text(path).select(place, F.col("value").cast("binary").alias("part"))
    return parts.mapInArrow(run, RECORD)


def write_warc(records: DataFrame, path: str) -> None:
    """One WARC file for each partition, by Spark's text writer, which passes bytes on as they are and ends each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                yield pa.RecordBatch.from_arrays([pa.array([to_warc(r)[:-4] for r in batch.slice(at, 200).to_pylist()], pa.binary())], names=["value"])

    records.select(*NAMES).mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").text(path)
