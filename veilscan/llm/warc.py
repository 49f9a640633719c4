"""WARC records: reading, writing, and derived metadata and plain-text conversion records.

Every `response` record gives a `metadata` record and a `conversion` record. Both refer to it by WARC-Refers-To, keep
its target and date, and carry digests of their own blocks; the metadata record lists the source's headers, digests,
title and links. Identifiers are version-5 UUIDs of the source's record, so deriving again gives the same records.
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
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, ship, table, tidy

DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
VERSION = "WARC/1.1"
#: Bytes of records that are handed on at once.
BYTES_AT_ONCE = 16_000_000
DERIVED = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, block binary"

#: Their content is no text; a title is none within a head.
SILENT = re.compile(r"<!--|<(script|style|template|noscript|title|head)\b[^>]*>", re.I)
CLOSES = {"": re.compile("-->"), **{x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "template", "noscript", "title")}}
#: Without an end, they take the rest of the page. Of the others, only the tag goes.
ENDLESS = ("", "script", "style")
#: What may stand between these in a head. Anything else ends it, since `</head>` and `<body>` may be left out.
IN_HEAD = re.compile(r"(?:\s|</?(?:meta|link|base|basefont|bgsound)\b[^>]*>|<[!?](?!--)[^>]*>)*+", re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul)\b[^>]*>", re.I)
CELL = re.compile(r"</?t[dh]\b[^>]*>", re.I)
TAG = re.compile(r"<[A-Za-z/!?][^>]*>")
TITLE = re.compile(r"<title\b[^>]*>", re.I)
HTML = re.compile(r"<html\b[^>]*>", re.I)
LANGUAGE = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
LINKING = re.compile(r"<(a|link|img|script|iframe)\b[^>]*>", re.I)
TARGET = re.compile(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
START = re.compile(rb"^WARC/", re.M)
CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n")
LINE = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(parts))}>"


# Names of WARC headers as they are written; any other case of them is the same header.
NAMES = {name.lower(): name for name in (
    "Content-Length", "Content-Type", "WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-IP-Address", "WARC-Refers-To", "WARC-Refers-To-Target-URI",
    "WARC-Refers-To-Date", "WARC-Concurrent-To", "WARC-Truncated", "WARC-Warcinfo-ID", "WARC-Filename", "WARC-Profile", "WARC-Identified-Payload-Type", "WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length",
)}
#: Bytes of a compressed file that are read at once.
STRETCH = 64 * 1024


def one_line(value: str) -> str:
    """A header's value: line ends would start another header."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def closed_tags(markup: str) -> int:
    """The place after the last `>`. Up to there every tag that begins also ends, so patterns of tags never look from
    each `<` to the end of a page in vain: the time is in proportion to the page."""
    return markup.rfind(">") + 1


def title_of(markup: str, bound: int) -> str | None:
    start = TITLE.search(markup, 0, bound)
    end = start and CLOSES["title"].search(markup, start.end())
    return html.unescape(LINE.sub(" ", markup[start.end() : end.start()])) if end else None


def language_of(markup: str, bound: int) -> str | None:
    tag = HTML.search(markup, 0, bound)
    found = tag and LANGUAGE.search(markup, tag.start(), tag.end())
    return found[1] if found else None


def links_of(markup: str, bound: int) -> Iterator[tuple[str, str, str]]:
    """(element, attribute, target) of each link: the first attribute of its tag that names one."""
    for tag in LINKING.finditer(markup, 0, bound):
        if found := TARGET.search(markup, tag.start(), tag.end()):
            yield tag[1].lower(), found[1].lower(), html.unescape(found[2] or found[3] or found[4] or "")


def audible(markup: str) -> str:
    """The markup without what is no text."""
    out, at, head, unclosed = [], 0, None, set()
    bound = max(closed_tags(markup), markup.rfind("<!--") + 4)
    while m := SILENT.search(markup, at, bound):
        name = (m[1] or "").lower()
        out.append(markup[at : m.start()])
        if head is not None and not IN_HEAD.fullmatch(markup, head, m.start()):
            head = None
        at = m.end()
        if name == "head":
            head = at
        elif name != "title" or head is not None:
            end = None if name in unclosed else CLOSES[name].search(markup, at)
            if end:
                at = end.end()
            elif name in ENDLESS:
                at = len(markup)
            else:
                unclosed.add(name)
            if head is not None:
                head = at
    out.append(markup[at:])
    return "".join(out)


def plain_text(markup: str) -> str:
    """The text that a reader sees: block elements break lines, cells become tabs, entities are decoded."""
    text = audible(markup)
    bound = closed_tags(text)
    text = TAG.sub("", CELL.sub("\t", BREAK.sub("\n", text[:bound]))) + text[bound:]
    lines = (LINE.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""

    def __bytes__(self) -> bytes:
        head = self.headers | {"Content-Length": str(len(self.block))}
        return (VERSION + "\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in head.items()) + "\r\n").encode() + self.block + b"\r\n\r\n"


@dataclass
class Response:
    """An HTTP response as a record's block holds it."""

    status: str
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @classmethod
    def parse(cls, block: bytes) -> Response:
        head, _, payload = block.partition(b"\r\n\r\n")
        status, *rest = head.decode("latin-1").split("\r\n")
        return cls(status, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest) if k}, payload)

    def content(self) -> bytes:
        """The payload without transfer and content encodings; as far as it goes where those are cut or malformed."""
        data = self.payload
        if "chunked" in self.headers.get("transfer-encoding", "").lower():
            data = unchunked(data)
        for coding in reversed(self.headers.get("content-encoding", "").lower().split(",")):
            if coding.strip() in ("gzip", "x-gzip", "deflate"):
                data = inflated(data)
        return data

    @property
    def charset(self) -> str:
        m = re.search(r"charset=[\"']?([\w-]+)", self.headers.get("content-type", ""), re.I)
        try:
            return "".encode(m[1]).decode() or m[1] if m else "utf-8"
        except LookupError:
            return "utf-8"


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while m := CHUNK_SIZE.match(data, at):
        n = int(m[1], 16)
        if not n:
            break
        out.append(data[m.end() : m.end() + n])
        at = m.end() + n + 2
    return b"".join(out) if at else data


def inflated(data: bytes) -> bytes:
    """gzip or deflate, as far as it goes; what is neither stays as it is."""
    for window in (47, -15):
        reader = zlib.decompressobj(window)
        try:
            found = reader.decompress(data)
        except zlib.error:
            continue
        if found or reader.eof:
            return found
    return data


def members(data: bytes, passed: list[bytes] | None = None) -> Iterator[bytes]:
    """Each gzip member's bytes, one at a time; plain data as they are. A cut member gives what it still holds, and data
    that are no member end the file: they are put into `passed`."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        start, reader = at, zlib.decompressobj(31)
        out: list[bytes] = []
        try:
            while at < len(data) and not reader.eof:
                out.append(reader.decompress(view[at : at + STRETCH]))
                at = min(at + STRETCH, len(data)) - len(reader.unused_data)
        except zlib.error:
            reader, out = zlib.decompressobj(31), []  # byte by byte up to the fault would be slow: by small stretches
            try:
                for i in range(start, len(data), 512):
                    out.append(reader.decompress(view[i : i + 512]))
            except zlib.error:
                pass
            if out:
                yield b"".join(out)
            if passed is not None:
                passed.append(data[start:])
            return
        yield b"".join(out)


def parse_file(data: bytes, passed: list[bytes] | None = None) -> Iterator[Record]:
    """All records of a WARC file, gzip or plain. Members are read one by one, and a record may not reach over two."""
    for member in members(data, passed):
        yield from parse_records(member, passed)


def parse_records(data: bytes, passed: list[bytes] | None = None) -> Iterator[Record]:
    """All records of a stretch of WARC data; gzip data are inflated whole first.

    After a cut or malformed record, reading goes on at the next line that starts one. Stretches that belong to no record
    are put into `passed`.
    """
    if data[:2] == b"\x1f\x8b":
        data = b"".join(members(data, passed))
    at = seek = 0
    skip = lambda stretch: passed.append(stretch) if passed is not None and stretch.strip(b"\r\n") else None
    while (found := START.search(data, seek)) or data.startswith(b"WARC/", seek):
        start = seek if data.startswith(b"WARC/", seek) else found.start()
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            break
        pairs = (x.partition(":") for x in data[start:end].decode("utf-8", "replace").split("\r\n")[1:])
        headers = {NAMES.get(k.strip().lower(), k.strip()): v.strip() for k, _, v in pairs if k}
        length = headers.get("Content-Length", "")
        if not re.fullmatch("[0-9]{1,18}", length) or end + 4 + int(length) > len(data):
            seek = end + 4
            continue
        skip(data[at:start])
        at = seek = end + 4 + int(length)
        yield Record({k: v for k, v in headers.items() if k != "Content-Length"}, data[end + 4 : at])
    skip(data[at:])


def response_record(uri: str, markup: bytes, date: str = DATE, content_type: str = "text/html; charset=utf-8") -> Record:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(markup)}\r\n\r\n".encode() + markup
    block_digest = digest(block)
    return Record({"WARC-Type": "response", "WARC-Record-ID": record_id(uri, date, block_digest), "WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": block_digest, "WARC-Payload-Digest": digest(markup)}, block)


def derived(source: Record) -> list[Record]:
    """The metadata and the conversion record of a response; nothing for records of other types."""
    if source.headers.get("WARC-Type") != "response":
        return []
    h = source.headers
    response = Response.parse(source.block)
    markup = response.content().decode(response.charset, "replace")
    bound = closed_tags(markup)
    origin, payload_digest = h.get("WARC-Record-ID", ""), h.get("WARC-Payload-Digest") or digest(response.payload)
    title, language = title_of(markup, bound), language_of(markup, bound)
    fields = [("source-record-id", origin), ("source-block-digest", h.get("WARC-Block-Digest") or digest(source.block)), ("source-payload-digest", payload_digest), ("http-status", response.status)]
    fields += [(f"http-header-{k}", v) for k, v in response.headers.items()]
    fields += [("charset", response.charset)] + ([("language", language)] if language else []) + ([("title", title)] if title is not None else [])
    fields += [("outlink", f"{target} {element}/@{attribute}") for element, attribute, target in links_of(markup, bound)]
    metadata = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    text = plain_text(markup).encode("utf-8", "replace")
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
        out.append(Record({"WARC-Type": kind, "WARC-Record-ID": record_id(origin, kind, digest(block)), "WARC-Refers-To": origin, "WARC-Target-URI": h.get("WARC-Target-URI", ""), "WARC-Date": h.get("WARC-Date", DATE), "Content-Type": mime, "WARC-Block-Digest": digest(block)}, block))
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, headers, block) of all records in the WARC files at `path`, each file in one task, a gzip member at a
    time.

    Stretches that belong to no record follow as rows without headers: malformed records, the rest of a cut or damaged
    file. Records before those are kept. A folder without files gives no rows.
    """
    ship(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                passed: list[bytes] = []
                rows, n, held = [], 0, 0
                for r in parse_file(bytes(data), passed):
                    rows.append((name, n, r.headers, r.block))
                    n, held = n + 1, held + len(r.block)
                    if held >= BYTES_AT_ONCE:
                        yield pd.DataFrame(rows, columns=["file", "n", "headers", "block"])
                        rows, held = [], 0
                rows += [(name, n + i, None, x) for i, x in enumerate(passed)]
                yield pd.DataFrame(rows, columns=["file", "n", "headers", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(tidy(parse), "file string, n long, headers map<string,string>, block binary")


def derive_records(responses: DataFrame, keys: tuple[str, ...] = (), headers: str = "headers", block: str = "block") -> DataFrame:
    """Metadata and conversion records of WARC records with `headers` (a map) and `block` (binary); `keys` are kept.

    Records are derived one by one: nothing is shuffled, and repeated rows give repeated records. A null block counts as
    empty, null headers as none, and records of other types give nothing. An empty table gives no rows. Transfer and
    content encodings are taken off. `keys` that are named like an output column are refused (ValueError).
    """
    ship(responses.sparkSession)
    kept_columns(responses)
    if clash := {k.lower() for k in keys} & {x.split()[0] for x in DERIVED.split(", ")}:
        raise ValueError(f"keys are named like outputs: {sorted(clash)}")
    schema = ", ".join([*[f"`{k}` {responses.schema[k].dataType.simpleString()}" for k in keys], DERIVED])

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, head, data in batch[[*keys, headers, block]].itertuples(index=False, name=None):
                for r in derived(Record(dict(head or {}), bytes(data or b""))):
                    rows.append((*key, *of(r)))
            yield pd.DataFrame(rows, columns=[*keys, *[x.split()[0] for x in DERIVED.split(", ")]])

    return responses.select(*keys, headers, block).mapInPandas(tidy(derive), schema)


def of(r: Record) -> tuple:
    h = r.headers
    source = re.search(rb"^source-payload-digest: (.*?)\r$", r.block, re.M) if h["WARC-Type"] == "metadata" else None
    return (h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"], h["Content-Type"], len(r.block), h["WARC-Block-Digest"], source[1].decode() if source else None, r.block)


def derive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """The records derived from stored pages: each is made a response first. Null pages and addresses count as empty,
    repeated rows give repeated records, other columns are left out, and an empty table gives no rows."""
    ship(pages.sparkSession)
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, {DERIVED}"

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *of(r)) for k, u, m in batch[[key, url, markup]].itertuples(index=False, name=None) for r in derived(response_record(u or "", (m or "").encode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=[key, *[x.split()[0] for x in DERIVED.split(", ")]]).astype({key: "object"})

    return pages.select(key, url, markup).mapInPandas(tidy(derive), schema)


def write_warc(records: DataFrame, path: str, headers: str = "headers", block: str = "block") -> None:
    """One gzip member for each record, as rows of a Parquet column `record`; joined in order they are a .warc.gz file."""
    ship(records.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"record": [gzip.compress(bytes(Record(dict(h or {}), bytes(b or b""))), mtime=0) for h, b in zip(batch[headers], batch[block], strict=True)]})

    records.select(headers, block).mapInPandas(tidy(pack), "record binary").write.parquet(path)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every row of `pages`, blocks as text. Null pages and addresses count as
    empty, repeated rows give repeated records, an empty table gives no rows."""
    found = derive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("block", F.col("block").cast("string"))
