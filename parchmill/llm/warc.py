"""WARC derivatives: metadata and plain-text conversion records from response records.

``response_record`` makes a response record of a page, ``parse_record`` reads one from bytes, and ``derive`` builds
for each response a metadata record (application/warc-fields: title, language, outlinks, HTTP headers, the source's own
headers and digests) and a conversion record (text/plain). Both refer to the response by WARC-Refers-To, with its target
URI and date preserved; block and payload digests are SHA-1 in base 32. Header names have no case, repeated headers and
folded lines are kept. Chunked, gzip and deflate bodies are decoded. Record ids are UUIDs of version 5 of what they
name, so a task that runs again writes the same records.

A page is read in one pass from tag to tag, in time that grows with its length whatever it holds: a tag ends at the next
``>``, comments and hidden elements at their end marks, and where there is no end mark the tag alone is left out.

Defined cases: a null URL is kept as an empty one; null or empty HTML gives a response without a body and an empty
conversion; bodies that are neither HTML nor text have no conversion; a record that cannot be parsed gives no derivatives
but a row of type ``error``, a record of another type a row of type ``skipped`` with its id; repeated rows get equal
records; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm.common import as_bytes, bounded_batches

#: Crawl date of page 0; page n was fetched n seconds later (pages carry no date of their own).
START = datetime(2024, 1, 1, tzinfo=timezone.utc)

#: Elements whose content is not text; elements that stand on lines of their own.
HIDDEN = frozenset("script style noscript template head".split())
BLOCK = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre hr title main aside td th form".split())
TAG = re.compile(r"<(?:(/?)([a-z][^\s/>]*)[^>]*|[!?/][^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
LOWER = {i: i + 32 for i in range(65, 91)}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


Headers = list[tuple[str, str]]


def header(headers: Headers, name: str, default: str | None = None) -> str | None:
    """The first header of this name, in whatever case."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def header_lines(head: str) -> Headers:
    """Headers in order; a line that begins with white space goes on with the one before."""
    out: Headers = []
    for line in head.split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse_record(data: bytes) -> tuple[Headers, bytes]:
    """Headers (names as written) and block of one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.decode("utf-8", "replace").partition("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = header_lines(lines)
    size = header(headers, "Content-Length", "")
    if not size.isdigit() or int(size) > len(rest):
        raise ValueError("broken Content-Length")
    return headers, rest[: int(size)]


def dechunked(body: bytes) -> bytes:
    """The content of a chunked body; what follows a broken chunk is left out."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def content(http: Headers, body: bytes) -> bytes:
    """The body without its transfer and content coding; as it is where it cannot be decoded."""
    if "chunked" in (header(http, "Transfer-Encoding") or "").lower():
        body = dechunked(body)
    coding = (header(http, "Content-Encoding") or "").lower()
    try:
        if "gzip" in coding or "deflate" in coding:
            return zlib.decompress(body, 47 if body[:2] == b"\x1f\x8b" or body[:1] == b"\x78" else -15)
    except zlib.error:
        pass
    return body


def decoded(http: Headers, body: bytes) -> str:
    """Text by the charset of the header, else that of the page's first kilobyte, else UTF-8."""
    named = CHARSET.search(header(http, "Content-Type") or "") or CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def one_line(text: str) -> str:
    return " ".join(text.split())


def response_record(key: int | None, url: str | None, body: bytes) -> bytes:
    """A response record of a page, with an HTTP block."""
    url = one_line(url or "")
    date = (START + timedelta(seconds=(key or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, date, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")],
        block,
    )


def attribute(tag: str, name: str) -> str | None:
    for m in ATTRIBUTE.finditer(tag):
        if m[1].translate(LOWER) == name:
            return next((html.unescape(v) for v in m.groups()[1:] if v is not None), "")
    return None


def _close(low: str, name: str, at: int) -> int:
    """Where the element's end tag ends, from ``at`` on; -1 if it has none."""
    while (at := low.find(f"</{name}", at)) >= 0:
        end = low.find(">", at)
        if end < 0:
            return -1
        if not low[at + 2 + len(name) : end].strip():
            return end + 1
        at = end
    return -1


def read_page(page: str) -> tuple[str | None, str | None, list[str], str]:
    """(title, language, outlinks, visible text): blocks on lines of their own, entities resolved, spaces collapsed."""
    low = page.lower()
    if len(low) != len(page):  # a letter whose lower case is longer: places must agree
        low = page.translate(LOWER)
    at, parts, links, lang, title = 0, [], [], None, None
    unclosed: set[str] = set()  # what has no end mark from here on
    if (start := low.find("<title")) >= 0 and (inner := low.find(">", start)) >= 0 and (end := low.find("</title", inner)) >= 0:
        title = one_line(html.unescape(page[inner + 1 : end]))
    for m in TAG.finditer(low, 0, low.rfind(">") + 1):  # up to the last end of a tag, so that each match ends
        start, end = m.span()
        if start < at:  # inside what is hidden
            continue
        parts.append(page[at:start])
        at, name = end, m[2]
        if name is None:
            if "--" not in unclosed and low.startswith("<!--", start):
                stop = low.find("-->", start + 4)
                if stop >= 0:
                    parts.append(" ")
                    at = stop + 3
                else:
                    unclosed.add("--")
        elif name in BLOCK:
            parts.append("\n")
        elif m[1]:
            continue
        elif name == "a":
            if (href := attribute(page[start + 2 : end - 1], "href")) is not None:
                links.append(one_line(href))
        elif name in HIDDEN and name not in unclosed:
            stop = _close(low, name, at)
            if stop >= 0:
                parts.append(" ")
                at = stop
            else:
                unclosed.add(name)
        elif name == "html" and lang is None:
            lang = attribute(page[start + 5 : end - 1], "lang") or None
    parts.append(page[at:])
    text = "".join(parts)
    lines = [" ".join(x.split()) for x in (html.unescape(text) if "&" in text else text).split("\n")]
    return title, lang, links, "\n".join(filter(None, lines))


def plain_text(page: str) -> str:
    return read_page(page)[3]


#: Headers of the source that its derivatives carry as their own; those that only describe the source's own block.
CARRIED = ("WARC-Warcinfo-ID", "WARC-Truncated")
OWN = frozenset(("content-length", "warc-block-digest", "warc-payload-digest"))


def derivatives(headers: Headers, block: bytes) -> list[tuple[str, Headers, bytes]]:
    """(type, headers, block) of the metadata and conversion records of a response."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = header_lines(head.decode("latin-1").partition("\r\n")[2])
    source, kind = header(headers, "WARC-Record-ID", ""), (header(http, "Content-Type") or "text/html").partition(";")[0].strip().lower()
    markup = kind in ("text/html", "application/xhtml+xml")
    page = decoded(http, content(http, body)) if markup or kind.startswith("text/") else None
    title, lang, links, text = read_page(page) if markup else (None, None, [], page)
    fields = [("title", title) if title is not None else None, ("languages", lang) if lang else None]
    fields += [("http-" + k.lower(), v) for k, v in http]
    fields += [("source-payload-digest", header(headers, "WARC-Payload-Digest", digest(body))), ("source-block-digest", header(headers, "WARC-Block-Digest", digest(block)))]
    fields += [("source-" + k.lower(), v) for k, v in headers if k.lower() not in OWN]
    fields += [("outlink", x) for x in links]
    meta = "".join(f"{k}: {v}\r\n" for k, v in filter(None, fields)).encode("utf-8", "replace")
    date, uri = header(headers, "WARC-Date", ""), header(headers, "WARC-Target-URI", "")
    linked = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    linked += [(k, v) for k in CARRIED if (v := header(headers, k)) is not None]
    made = [("metadata", "application/warc-fields", meta)]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    return [
        (kind, [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), *linked, ("WARC-Block-Digest", digest(own)), *([("WARC-Payload-Digest", digest(own))] if kind == "conversion" else []), ("Content-Type", media)], own)
        for kind, media, own in made
    ]


def page_responses(pages: DataFrame) -> DataFrame:
    """page_id and the response record (binary) of each page."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response_record(k, u, h) for k, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, record binary")


RESULT = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, block_digest string, content_length long, record_sha256 string"


def derive(responses: DataFrame, keep_records: bool = True) -> DataFrame:
    """One row for each derived record; ``record`` holds its bytes if kept."""
    bounded_batches(responses.sparkSession)
    schema = RESULT + (", record binary" if keep_records else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(key, data):
        try:
            source, block = parse_record(data or b"")
        except ValueError as e:
            yield key, "error", None, None, None, None, None, None, None, str(e), *([None] if keep_records else [])
            return
        if (header(source, "WARC-Type") or "").lower() != "response":
            yield key, "skipped", header(source, "WARC-Record-ID"), None, header(source, "WARC-Target-URI"), header(source, "WARC-Date"), None, None, None, None, *([None] if keep_records else [])
            return
        for kind, headers, block in derivatives(source, block):
            h, made = dict(headers), record(headers, block)
            yield key, kind, h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"], h.get("WARC-Payload-Digest"), h["WARC-Block-Digest"], len(block), hashlib.sha256(made).hexdigest(), *([made] if keep_records else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 7, pa.int64(), pa.string(), pa.binary()][: len(names)]
        for b in batches:
            out = [r for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rows(k, d)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    return responses.select(F.col("page_id").cast("long").alias("page_id"), "record").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(page_responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), keep_records=False)
