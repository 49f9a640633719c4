"""Extraction: files and structured text become records separated by form feeds, with status and reason.

A record holds the scalar fields of one object or element. What is nested is a record of its own, so an identifier of a
parent never stands in the record of its child. Input that can't be read safely is cut at every delimiter and reported
as partial.
"""

from __future__ import annotations

import csv
import html.parser
import io
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

# Limits of structured input, and the reasons given.
MAX_DEPTH, MAX_NODES, MAX_RECORDS, MAX_CHARS = 64, 100_000, 10_000, 10_000_000
UNVERIFIED, LIMIT = "structured_record_boundaries_unverified", "structured_text_limit_reached"

EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("examined", T.LongType()), T.StructField("linkage_verified", T.BooleanType())])
RENDERED = T.StructType([T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())])


class Refused(ValueError):
    """Not well-formed, unsafe, or beyond a limit."""


def kind_of(text: str) -> str | None:
    start = text.lstrip()
    if start[:1] in ("{", "["):
        return "json"
    return "xml" if re.match(r"<(?:\?xml\b|[A-Za-z_][\w:.-]*(?:\s|>|/))", start) else None


def parse_json(text: str):
    """JSON whose objects name each key once."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise Refused("duplicate key")
        return found

    return json.loads(text, object_pairs_hook=unique)


def parse_xml(text: str) -> ElementTree.Element:
    """XML without document types and entities, which could refer to files or grow without bound."""

    def refuse(*_: object) -> None:
        raise Refused("document type or entity")

    builder, parser = ElementTree.TreeBuilder(), expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler = lambda tag, attrs: builder.start(tag, attrs)
    parser.EndElementHandler = builder.end
    parser.CharacterDataHandler = builder.data
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    parser.Parse(text, True)
    return builder.close()


@dataclass
class Records:
    """Collects records in document order, within limits. Work is kept on a stack, so depth costs no recursion."""

    maximum: int
    found: list[str] = field(default_factory=list)
    chars: int = 0
    nodes: int = 0

    def put(self, record: str) -> None:
        if record.strip():
            self.chars += len(record) + (1 if self.found else 0)
            if self.chars > self.maximum or len(self.found) == MAX_RECORDS:
                raise Refused("too much text or too many records")
            self.found.append(record)

    def visit(self, depth: int) -> None:
        self.nodes += 1
        if depth > MAX_DEPTH or self.nodes > MAX_NODES:
            raise Refused("too deep or too many nodes")

    def read(self, root: tuple[str, object]) -> None:
        stack: list[tuple[str, object, int]] = [(*root, 0)]
        while stack:
            kind, value, depth = stack.pop()
            after = {"json": self.json, "xml": self.xml, "text": self.text}[kind](value, depth)
            stack += [(k, v, depth + 1) for k, v in reversed(after)]

    def text(self, value: str, _: int) -> list:
        self.put(value)
        return []

    def json(self, value: object, depth: int) -> list[tuple[str, object]]:
        self.visit(depth)
        shown = lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        if isinstance(value, list):
            return [("json", x) for x in value]
        if not isinstance(value, dict):
            self.put(shown(value))
            return []
        inner = {k: nested(x) for k, x in value.items()}
        self.put(" | ".join(f"{json.dumps(k, ensure_ascii=False)}: {shown(value[k])}" for k, x in inner.items() if x is None))
        return [x for x in inner.values() if x is not None]

    def xml(self, e: ElementTree.Element, depth: int) -> list[tuple[str, object]]:
        self.visit(depth)
        fields = [f"{local(k)}: {v}" for k, v in e.attrib.items()]
        serialized: list[tuple[str, object]] = []

        def own(tag: str, text: str) -> None:
            if kind_of(text):
                serialized.append(nested(text))  # type: ignore[arg-type]
            else:
                fields.append(f"{local(tag)}: {text}")

        if e.text and e.text.strip():
            own(e.tag, e.text)
        often = Counter(c.tag for c in e)
        simple = [c for c in e if not len(c) and not c.attrib and often[c.tag] == 1]
        for c in simple:
            self.visit(depth + 1)
            if c.text:
                own(c.tag, c.text)
        self.put(" | ".join(fields))
        plain = set(map(id, simple))
        return [("xml", c) for c in e if id(c) not in plain] + serialized + [("text", c.tail) for c in e if c.tail]


def local(tag: str) -> str:
    return re.split("[}:]", tag)[-1]


def nested(value: object) -> tuple[str, object] | None:
    """What is a record of its own: containers, and strings that hold serialized ones."""
    if isinstance(value, (dict, list)):
        return "json", value
    if isinstance(value, str) and (kind := kind_of(value)):
        return kind, parse_xml(value) if kind == "xml" else parse_json(value)
    return None


def render(text: str, kind: str, maximum: int = 1_000_000) -> tuple[str, str | None]:
    """Records joined by form feeds, and a reason if their boundaries aren't certain."""
    maximum = min(max(maximum, 1), MAX_CHARS)
    head, reason = text[:maximum], LIMIT if len(text) > maximum else None
    records: list[str] | None = None
    if not reason:
        try:
            to = Records(maximum)
            roots = [("xml", parse_xml(head))] if kind == "xml" else [("json", parse_json(x)) for x in (head.splitlines() if kind == "jsonl" else [head]) if kind == "json" or x.strip()]
            for root in roots:
                to.read(root)
            records = to.found
        except Exception:
            reason = UNVERIFIED
    if records is None:
        opened = re.sub(r"<([A-Za-z_][\w:.-]*)[^>]*>", "\f\\1: ", re.sub("</[^>]*>", "\f", head))
        records = re.split(r"[{}\[\],<>\f]|\\[nrtf]", opened)
    joined = "\f".join(r for r in records if r.strip())
    return (joined, reason) if len(joined) <= maximum else (joined[:maximum], reason or LIMIT)


def render_table(text: str, delimiter: str, maximum: int) -> tuple[str, bool]:
    """Rows of delimited text as records; a first row of known labels names the cells of the others and stays a record.

    Cells that hold JSON or XML are records of their own. False if the boundaries in one of those aren't certain.
    """
    rows = csv.reader(io.StringIO(text), delimiter=delimiter, strict=True)
    certain, room, out = True, maximum + 1, []
    labels: list[str] | None = None
    for n, row in enumerate(rows):
        if room <= 0:
            break
        plain, inner = [], []
        for i, cell in enumerate(row):
            if kind := kind_of(cell):
                shown, reason = render(cell, kind, maximum)
                certain &= reason is None
                inner.append(shown)
            else:
                plain.append(f"{labels[i] if i < len(labels) else 'field'}: {cell}" if labels else cell)
        if n == 0:
            names = [x.strip() for x in row]
            if names and all(re.fullmatch("[A-Za-z][A-Za-z_ -]{0,63}", x) for x in names) and P.HEADER_NAMES & {x.lower() for x in names}:
                labels = names
            if not row:
                continue
        for record in ([" | ".join(plain)] if plain else []) + [x for x in inner if x]:
            if room > 0:
                piece = ("\f" if out else "") + record
                out.append(piece[:room])
                room -= len(out[-1])
    return "".join(out), certain


class Page(html.parser.HTMLParser):
    """Text of a page: records at rows and page bodies, paragraphs at blocks, tabs at cells; nothing of scripts."""

    BLOCKS, CELLS, SILENT = {"p", "section", "h1", "h2", "h3"}, {"td", "th"}, {"head", "script", "style"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def _mark(self, tag: str, attrs: dict[str, str | None]) -> None:
        classes = (attrs.get("class") or "").split()
        mark = "\f" if tag == "tr" or (tag == "div" and {"page", "ocr_page"} & set(classes)) else "\n\n" if tag in self.BLOCKS else "\n" if tag == "br" else "\t" if tag in self.CELLS else " " if {"ocrx_word", "ocr_word"} & set(classes) else ""
        if mark and not self.silent:
            self.out.append(mark)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.silent += tag in self.SILENT
        self._mark(tag, dict(attrs))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT and self.silent:
            self.silent -= 1
        elif tag in self.BLOCKS or tag == "tr":
            self._mark(tag, {})

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data)


def page_text(markup: str) -> str:
    page = Page()
    page.feed(markup)
    page.close()
    return "".join(page.out)


class Sheets(Page):
    """The text of each page element by itself, and what stands outside of all of them.

    A page within a page, an element that ends twice or never: then the order of pages can't be trusted, and `sound` is
    false. Text of a page that never ends counts as outside.
    """

    def __init__(self) -> None:
        super().__init__()
        self.outside, self.pages, self.divisions, self.sound = self.out, [], [], True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        page = tag == "div" and "page" in (dict(attrs).get("class") or "").split()
        begins = page and self.out is self.outside
        if begins:
            self.out = []
        super().handle_starttag(tag, attrs)
        if begins:
            # The mark between pages belongs to neither of them.
            self.out.clear()
            self.pages.append(self.out)
        if tag == "div":
            self.divisions.append(begins)
        self.sound &= begins or not page

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        if tag == "div":
            self.sound &= bool(self.divisions)
            if self.divisions and self.divisions.pop():
                self.out = self.outside

    def result(self) -> tuple[list[str], str, bool]:
        self.close()
        if self.out is not self.outside:
            self.outside += self.pages.pop()
        return ["".join(p) for p in self.pages], "".join(self.outside), self.sound and not self.divisions


SHEETS = T.StructType([T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("outside", T.StringType()), T.StructField("sound", T.BooleanType()), T.StructField("text", T.StringType())])


def page_sheets(markup: str | None) -> tuple[list[str], str, bool, str]:
    """SHEETS of markup: its pages, the text outside of them, whether their order can be trusted, and all of its text."""
    reader = Sheets()
    reader.feed(markup or "")
    return *reader.result(), page_text(markup or "").strip(" \n\r\t\f")


def supplement(pages: list[str], native: list[str]) -> list[str]:
    """Pages that don't equal, but for white space and normal form, the native page at the same place."""
    plain = lambda x: " ".join(unicodedata.normalize("NFC", x).split())
    return [p for i, p in enumerate(pages) if i >= len(native) or plain(p) != plain(native[i])]


def extract(data: bytes | None, suffix: str, maximum: int = 1_000_000) -> tuple:
    """EXTRACTED of a file's content: its text in records, or why there is none. Null content counts as empty."""
    data, suffix = data or b"", suffix.lower()
    maximum = min(max(maximum, 1), MAX_CHARS)
    if suffix in P.ARCHIVE_SUFFIXES:
        return "", "excluded", "archive_scanning_disabled", "bytes", 0, True
    if suffix not in P.TEXT_SUFFIXES:
        known = suffix in P.DOCUMENT_SUFFIXES
        return "", "unsupported", "tika_not_configured" if known else "unsupported_file_format", "bytes", 0, True
    encoding = "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig"
    status, reason, linkage = "full", None, True
    try:
        text = data.decode(encoding)
    except UnicodeError:
        text, status, reason = data.decode(encoding, "replace"), "partial", "encoding_replacement"
    if "\0" in text:
        return "", "unsupported", "binary_content_in_text_file", "bytes", 0, True
    if suffix in (".csv", ".tsv"):
        try:
            text, certain = render_table(text, "\t" if suffix == ".tsv" else ",", maximum)
            if not certain:
                status, reason, linkage = "partial", "csv_structured_cell_boundaries_unverified", False
        except csv.Error:
            text, status, reason, linkage = "\f".join(text.splitlines()), "partial", "csv_structure_or_field_limit", False
    elif suffix in (".json", ".jsonl", ".xml"):
        text, why = render(text, suffix[1:], maximum)
        if why:
            status, reason = "partial", why
    elif suffix == ".hl7":
        text = "\f".join(text.splitlines())
    if len(text) > maximum:
        text, status, reason = text[:maximum], "partial", "text_limit_reached"
    return text, status, reason, "characters", len(text), linkage


def _series(function: Callable, schema: T.DataType, n: int) -> Callable[..., Column]:
    if n == 1:

        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([function(x) for x in batch], index=batch.index, dtype=object)

        one.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(one, schema)

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([function(*x) for x in zip(*batch, strict=True)], columns=schema.fieldNames())  # type: ignore[attr-defined]

    many.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(many, schema)


def render_udf(maximum: int = MAX_CHARS) -> Callable[..., Column]:
    """(text, kind) -> RENDERED; a null kind gives nulls, so other rows pass by."""
    return _series(lambda text, kind: render(text, kind, maximum) if kind else (None, None), RENDERED, 2)


def extract_udf(maximum: int = 1_000_000) -> Callable[..., Column]:
    return _series(lambda data, suffix: extract(data, suffix, maximum), EXTRACTED, 2)


def page_text_udf() -> Callable[..., Column]:
    return _series(lambda x: page_text(x or ""), T.StringType(), 1)


def page_sheets_udf() -> Callable[..., Column]:
    """markup -> SHEETS."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([page_sheets(x) for x in batch], columns=SHEETS.fieldNames())

    read.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(read, SHEETS)
