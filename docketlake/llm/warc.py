"""WARC derivatives: metadata and plain-text conversion records for response records.

A record is a row: record_id, record_type, target_uri, date, refers_to, content_type, payload_digest, block_digest,
headers (further named fields, in order) and block (the bytes after the record header).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow
from .html import Page, parse

RECORD = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, content_type string, "
    "payload_digest string, block_digest string, headers array<struct<name:string,value:string>>, block binary"
)
_NAMES = [x.split()[0] for x in RECORD.replace("name:string,value:string", "x").split(", ")]
_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_TYPES = [pa.string()] * 8 + [_FIELDS, pa.binary()]
#: The named fields that have columns of their own.
_COLUMNS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Target-URI": "target_uri", "WARC-Date": "date",
    "WARC-Refers-To": "refers_to", "Content-Type": "content_type", "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest",
}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(*parts: str) -> str:
    """A record id that the same parts always give, so a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES)], _NAMES)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records for page snapshots (page_id, url, html); null url or html are empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for page_id, url, html in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html"))):
            payload = (html or "").encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            rows.append({
                "record_id": named_id("response", str(page_id), url or ""), "record_type": "response", "target_uri": url or "", "date": date,
                "content_type": "application/http; msgtype=response", "payload_digest": digest(payload), "block_digest": digest(head + payload),
                "headers": [{"name": "X-Page-Id", "value": str(page_id)}] if page_id is not None else [], "block": head + payload,
            })
        return _batch(rows)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(slim, run, RECORD)


def split_http(block: bytes) -> tuple[str, list[dict], bytes]:
    """(status line, headers, body) of an HTTP response; a block without a header end is all body."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("latin-1")).split("\r\n")
    fields = [{"name": n.strip(), "value": v.strip()} for n, colon, v in (x.partition(":") for x in lines[1:]) if colon]
    return lines[0], fields, body


def _header(fields: list[dict], name: str) -> str:
    return next((f["value"] for f in fields if f["name"].lower() == name), "")


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; what follows a broken chunk head is kept as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return b"".join(out) + body[at:]
        if size <= 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) + body[at:]


def _inflated(body: bytes, bits: int) -> bytes:
    """All members of a zlib stream; of one that is cut off, what can be read."""
    out = []
    while body:
        stream = zlib.decompressobj(bits)
        out.append(stream.decompress(body))
        out.append(stream.flush())
        body = stream.unused_data.lstrip(b"\0")
        if not stream.eof:
            break
    return b"".join(out)


def decoded_body(fields: list[dict], body: bytes) -> tuple[bytes, bool]:
    """The body without its transfer and content encodings, and whether all of these could be undone."""
    if "chunked" in _header(fields, "transfer-encoding").lower():
        body = unchunked(body)
    for coding in reversed(_header(fields, "content-encoding").lower().replace(" ", "").split(",")):
        try:
            if coding in ("gzip", "x-gzip"):
                body = _inflated(body, 47)
            elif coding == "deflate":
                try:
                    body = _inflated(body, 15)
                except zlib.error:
                    body = _inflated(body, -15)
            elif coding == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif coding not in ("", "identity"):
                return body, False
        except (zlib.error, zstandard.ZstdError):
            return body, False
    return body, True


_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([a-zA-Z0-9_.:-]+)", re.I)


def decoded_text(fields: list[dict], body: bytes) -> str:
    """The body as text: by its byte order mark, the header's charset, the page's own, or UTF-8; unknown charsets are UTF-8.

    Latin-1 and ASCII are read as Windows-1252, as browsers do. Bytes that are no text become U+FFFD.
    """
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    named = next((name for mark, name in marks if body.startswith(mark)), None)
    if named is None:
        named = _header(fields, "content-type").lower().partition("charset=")[2].split(";")[0].strip(" \"'")
        own = _META.search(body[:1024])
        named = named or (own[1].decode().lower() if own else "utf-8")
    if named.replace("_", "-") in ("iso-8859-1", "latin-1", "latin1", "ascii", "us-ascii"):
        named = "cp1252"
    try:
        return body.decode(named, "replace")
    except (LookupError, ValueError):  # no such charset, none of text, or a name that is none
        return body.decode("utf-8", "replace")


def text_of(fields: list[dict], body: bytes) -> tuple[str | None, Page | None]:
    """(plain text, the page if it is one) of a response body; null text for types that hold none."""
    kind = _header(fields, "content-type").lower().split(";")[0].strip()
    if kind in ("", "text/html", "application/xhtml+xml"):
        page = parse(decoded_text(fields, body))
        return "\n".join(b[1] for b in page.blocks), page
    if kind.startswith("text/") or kind.endswith(("json", "xml", "javascript")):
        return decoded_text(fields, body), None
    return None, None


def derive(record: dict) -> list[dict]:
    """The metadata and, where the response holds text, the conversion record of one response record."""
    status, fields, payload = split_http(record["block"] or b"")
    body, whole = decoded_body(fields, payload)
    text, page = text_of(fields, body) if whole else (None, None)
    source = record["payload_digest"] or digest(payload)
    carried = [f for f in record["headers"] or [] if f["name"] not in _COLUMNS]
    about = {
        "envelope": {"record_id": record["record_id"], "target_uri": record["target_uri"], "date": record["date"], "payload_digest": source, "block_digest": record["block_digest"]},
        "http": {"status": status, "headers": fields, "decoded": whole},
        "html": {"title": page.title, "links": [{"url": u, "text": t} for u, t in page.links]} if page else None,
    }
    blocks = {"metadata": ("application/json", json.dumps(about, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "replace"))}
    if text is not None:
        blocks["conversion"] = ("text/plain; charset=utf-8", text.encode("utf-8", "replace"))
    return [
        {
            "record_id": named_id(kind, record["record_id"] or ""), "record_type": kind, "target_uri": record["target_uri"], "date": record["date"],
            "refers_to": record["record_id"], "content_type": content_type, "payload_digest": source, "block_digest": digest(block), "headers": carried, "block": block,
        }
        for kind, (content_type, block) in blocks.items()
    ]


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records for the response records of ``records``; other records give none.

    Two rows for each response that holds text, one (metadata) for others. They refer to it by refers_to and keep its date,
    target, further named fields and payload digest; the metadata block is JSON with the HTTP headers as name and value
    pairs in order, and a page's title and links; the conversion block is the text, of pages one line a block.

    Chunked transfers and gzip, deflate and zstd bodies are undone; a body in another coding, or broken, has no conversion
    and "decoded" false. Charsets that do not exist are UTF-8. Null blocks are empty pages; null fields stay null; repeated
    records give repeated (equal) derivatives; an empty table gives none; further columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _batch([x for record in batch.to_pylist() for x in derive(record)])

    return map_arrow(records.where("record_type = 'response'").select(*_NAMES), run, RECORD)


def to_bytes(record: dict) -> bytes:
    """A record as it stands in a WARC file, with the two line ends that close it."""
    named = {v: k for k, v in _COLUMNS.items()}
    lines = ["WARC/1.1"] + [f"{named[n]}: {record[n]}" for n in _NAMES[:8] if record[n] is not None]
    lines += [f"{f['name']}: {f['value']}" for f in record["headers"] or []]
    block = record["block"] or b""
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


_NAMED = {name.lower(): column for name, column in _COLUMNS.items()}


def from_bytes(raw: bytes) -> dict | None:
    """One record from its bytes, without the version line's 'WARC/1.'; None where there is no header.

    Field names are read in any case. A block shorter than its Content-Length gets a WARC-Truncated field if it has none.
    """
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    if not any(":" in x for x in lines):
        return None
    record: dict = dict.fromkeys(_NAMES) | {"headers": []}
    length = None
    for line in lines:
        name, _, value = (x.strip() for x in line.partition(":"))
        if name.lower() in _NAMED:
            record[_NAMED[name.lower()]] = value
        elif name.lower() == "content-length":
            length = int(value) if value.isdecimal() else None
        elif name:
            record["headers"].append({"name": name, "value": value})
    record["block"] = rest if length is None else rest[:length]
    if (not sep or length is None or len(rest) < length) and not any(f["name"].lower() == "warc-truncated" for f in record["headers"]):
        record["headers"].append({"name": "WARC-Truncated", "value": "unspecified"})
    return record


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path``, plain or (by their .gz ending) gzip.

    Spark's text reader cuts the files at the version lines, so plain files are read in splits and gzip files as a stream,
    whatever their size; a record is a row. A block that itself holds a version line after a blank one ends there and is
    marked as truncated.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [r for raw in batch.column("raw").to_pylist() if (r := from_bytes(raw)) is not None]
        return _batch(rows) if rows else None

    lines = spark.read.option("lineSep", "\r\n\r\nWARC/1.").text(path)
    return map_arrow(lines.select(F.col("value").cast("binary").alias("raw")), run, RECORD)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files, one for each partition, by Spark's own text writer; blocks may hold any bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([to_bytes(r)[:-4] for r in batch.to_pylist()], pa.binary())], ["raw"])

    rows = map_arrow(records.select(*_NAMES), run, "raw binary").select(F.col("raw").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
