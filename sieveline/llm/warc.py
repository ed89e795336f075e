"""Web-archive derivatives: each response record gives a metadata record and a plain-text conversion record.

Both name the response they refer to (identifier, target and date) and carry its headers and digests on. A response is
(record_id, target_uri, date, block): block holds the HTTP status line, headers, an empty line and the payload. Where it
also has warc_headers (an array of name and value), the record's own headers, they are carried on, and the digests that
they state are preserved as they stand; digests that they lack are computed. Text comes from the payload after its
transfer coding (chunked) and content codings (gzip, deflate) are undone; where a coding is broken, from what could be read.

Defined cases: a null block is an empty one; a block without an end of headers is all payload, without status or
headers; a null target or date leaves that header out; the text of an empty payload is empty, and its record has
length 0; bytes that don't fit the declared charset are replaced; repeated rows give the same records again; an empty
table gives none; columns other than the named ones and `keep` are not read.
Names in `keep` that the result has must be renamed before.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

SPACE = uuid.UUID("6f1f3a2e-5f0e-4b44-9a55-9d0b3a4a2c11")
HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)")
BREAKS = re.compile(r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|section|article|header|footer|nav|aside|main|form|title|blockquote|pre|hr|body|head|figure|option)\b[^>]*>")
CELL = re.compile(r"(?i)</t[dh]\s*>")
TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
CHARSET = re.compile(rb"""(?i)charset\s*=\s*["']?([\w.:-]+)""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_block(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers in their order (a line that starts with white space goes on the one before), payload."""
    m = re.search(rb"\r?\n\r?\n", block)
    if not block.startswith(b"HTTP/") or not m:
        return None, [], block
    first, *lines = re.split(r"\r?\n", block[: m.start()].decode("latin-1"))
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    status = re.match(r"HTTP/\S+\s+(\d{3})", first)
    return int(status[1]) if status else None, headers, block[m.end() :]


def dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return data if not out else b"".join(out)
        if not n:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def inflated(data: bytes, bits: int) -> bytes | None:
    """What can be read of one or more members; None if nothing can."""
    out = []
    while data:
        d = zlib.decompressobj(bits)
        try:
            for at in range(0, len(data), 1 << 16):
                out.append(d.decompress(data[at : at + (1 << 16)]))
            out.append(d.flush())
        except zlib.error:
            break
        if not d.eof or bits < 0:
            break
        data = d.unused_data
    return b"".join(out) or None


def body(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content codings. Payloads that don't have what the headers say stay as they are."""
    of = {n.lower(): v.lower() for n, v in headers}
    if "chunked" in of.get("transfer-encoding", ""):
        payload = dechunked(payload)
    for coding in reversed(of.get("content-encoding", "").split(",")):
        if coding.strip() in ("gzip", "x-gzip"):
            payload = inflated(payload, 31) or payload
        elif coding.strip() == "deflate":
            payload = inflated(payload, 15) or inflated(payload, -15) or payload
    return payload


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    said = next((v for n, v in headers if n.lower() == "content-type"), "").encode("latin-1", "replace")
    m = CHARSET.search(said) or CHARSET.search(payload[:1024])
    try:
        return payload.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """Visible text, a line for each block; runs of white space are one space; no empty lines."""
    t = CELL.sub("\t", HIDDEN.sub(" ", page))
    # no tag ends behind the last >; looking for one there from every < would take quadratic time
    end = t.rfind(">") + 1
    t = TAG.sub("", BREAKS.sub("\n", t[:end])) + t[end:]
    lines = (" ".join(x.split()) for x in html.unescape(t).split("\n"))
    return "\n".join(x for x in lines if x)


FIELDS = [
    ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("refers_to_target_uri", pa.string()), ("refers_to_date", pa.string()),
    ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_block_digest", pa.string()), ("source_payload_digest", pa.string()),
    ("http_status", pa.int32()), ("source_headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
    ("source_warc_headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("content", pa.string()),
]
DDL = (
    "record_type string, record_id string, refers_to string, refers_to_target_uri string, refers_to_date string, content_type string, content_length long, block_digest string, "
    "source_block_digest string, source_payload_digest string, http_status int, source_headers array<struct<name: string, value: string>>, source_warc_headers array<struct<name: string, value: string>>, content string"
)


def derive(record_id: str | None, target: str | None, date: str | None, block: bytes | None, warc: list[dict] | None = None) -> list[tuple]:
    block = block or b""
    status, headers, payload = split_block(block)
    stated = {(h["name"] or "").lower(): h["value"] for h in warc or [] if h}
    whole, part = stated.get("warc-block-digest") or digest(block), stated.get("warc-payload-digest") or digest(payload)
    text = plain_text(decoded(body(payload, headers), headers))
    kind = next((v for n, v in headers if n.lower() == "content-type"), None)
    lines = [("derived-conversion", own("conversion", record_id, whole)), ("source-block-digest", whole), ("source-payload-digest", part), ("payload-length", str(len(payload)))]
    lines += [("http-status", str(status))] * (status is not None) + [("http-content-type", kind)] * (kind is not None)
    lines += [(f"http-header-{n.lower()}", v) for n, v in headers]
    lines += [(f"warc-header-{n}", v) for n, v in stated.items() if v is not None]
    fields = "".join(f"{n}: {v}\r\n" for n, v in lines)
    said = [{"name": n, "value": v} for n, v in headers]
    out = []
    for name, mime, content in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text)):
        data = content.encode("utf-8", "replace")
        out.append((name, own(name, record_id, whole), record_id, target, date, mime, len(data), digest(data), whole, part, status, said, warc, content))
    return out


def own(kind: str, record_id: str | None, whole: str) -> str:
    """An identifier that is the same on every run."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {record_id} {whole}')}>"


def derivatives(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """responses (record_id, target_uri, date strings, block binary) -> two rows each; `keep` names columns to carry along."""
    tune(responses.sparkSession)
    keep = keep or []
    if clash := sorted({c.lower() for c in keep} & {n for n, _ in FIELDS}):
        raise ValueError(f"rename the columns {clash} first")
    more = [F.transform("warc_headers", lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value"))).alias("warc_headers")] if "warc_headers" in responses.columns else []
    columns = 4 + len(more)
    given = responses.select(*keep, "record_id", "target_uri", "date", "block", *more)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keep)]] + [DDL])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [r for x in zip(*(part.column(len(keep) + i).to_pylist() for i in range(columns)), strict=True) for r in derive(*x)]
                twice = pa.array([i // 2 for i in range(2 * part.num_rows)])
                made = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(twice) for i in range(len(keep))), *made], [*keep, *(n for n, _ in FIELDS)])

    return given.mapInArrow(each, ddl)


def serialize(row: dict) -> bytes:
    """A derivative as one gzip member of an archive file."""
    date = row["refers_to_date"] or "1970-01-01T00:00:00Z"
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Refers-To-Target-URI", row["refers_to_target_uri"])]
    head += [("WARC-Refers-To-Date", row["refers_to_date"]), ("WARC-Target-URI", row["refers_to_target_uri"]), ("WARC-Date", date), ("WARC-Block-Digest", row["block_digest"])]
    head += [("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"]))]
    text = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head if v is not None) + "\r\n"
    return gzip.compress(text.encode() + row["content"].encode("utf-8", "replace") + b"\r\n\r\n", mtime=0)


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) as response records, with identifiers made from page_id and url."""
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    cut = lambda a, n: F.substring(h, a, n)
    name = F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12), F.lit(">"))
    body = F.coalesce("html", F.lit(""))
    head: Column = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", name.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).cast("binary").alias("block"))


def op1(pages: DataFrame) -> DataFrame:
    return derivatives(responses_from_pages(pages), ["page_id"])
