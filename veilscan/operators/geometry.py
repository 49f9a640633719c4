"""Words with boxes from what tools write about a page: box markup, tab-separated rows, and the page's own measures.

Tab-separated rows are column expressions throughout. Markup is nested, so it goes through an event reader in Arrow
batches that keeps a stack of names and no tree. Both give the same rows: words in normalised coordinates, or one row
with the fixed code of the page's first fault and no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isfinite
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import ship, spread

# Limits of a page's geometry, codes, columns of the rows, dots of an inch and points of an inch.
MAX_BYTES, MAX_WORDS, MAX_CHARS, MAX_WORD, ROWS_A_WORD = 4 * 1024 * 1024, 10_000, 250_000, 512, 5
LIMIT, INVALID, UNVERIFIED = "geometry_limit", "geometry_invalid", "geometry_text_unverified"
TSV_COLUMNS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
DOTS, POINTS = 200, 72

BOXES = ("left", "top", "right", "bottom")
WORD_ROW = "fault string, ordinal int, text string, left double, top double, right double, bottom double, block int, line int"
#: A word has none of these: blanks, control characters.
ODD_CHARACTER = r"(?U)[\s\x00-\x1f\x7f-\x9f\x{1c}-\x{1f}]"


class Fault(Exception):
    """A page's fixed code."""


@dataclass
class BoxReader:
    """Events of one page's markup to rows (text, left, top, right, bottom, block, line) in points.

    A word counts only as a child of a line that is a child of a block; any other place of a word, another element in a
    line, an element in a word, a second page or a declared entity is a fault.
    """

    size: tuple[float, float] | None = None
    rows: list[tuple] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    #: For each open block its number and its lines so far.
    blocks: list[list[int]] = field(default_factory=list)
    n_blocks: int = 0
    held: list[str] = field(default_factory=list)
    at: list[float] = field(default_factory=list)

    def numbers(self, given: dict[str, str], *names: str) -> list[float]:
        try:
            found = [float(given[n]) for n in names]
        except (KeyError, ValueError):
            raise Fault(INVALID) from None
        if not all(map(isfinite, found)):
            raise Fault(INVALID)
        return found

    def begin(self, name: str, given: dict[str, str]) -> None:
        name = name.rpartition("}")[2]
        outer = self.names[-1] if self.names else ""
        inside = "page" in self.names
        self.names.append(name)
        if name == "page":
            if self.size is not None:
                raise Fault(INVALID)
            self.size = tuple(self.numbers(given, "width", "height"))  # type: ignore[assignment]
            if min(self.size) <= 0:
                raise Fault(INVALID)
        elif not inside:
            return
        elif outer == "word" or (outer == "line" and name != "word" and self.names[-3:-2] == ["block"]):
            raise Fault(INVALID)
        elif name == "block":
            self.n_blocks += 1
            self.blocks.append([self.n_blocks, 0])
            if self.n_blocks > MAX_WORDS:
                raise Fault(LIMIT)
        elif name == "line" and outer == "block":
            self.blocks[-1][1] += 1
        elif name == "word":
            if self.names[-3:-1] != ["block", "line"]:
                raise Fault(INVALID)
            self.held, self.at = [], self.numbers(given, "xMin", "yMin", "xMax", "yMax")

    def text(self, data: str) -> None:
        if self.names[-1:] == ["word"]:
            self.held.append(data)

    def end(self, _: str) -> None:
        name = self.names.pop()
        if "page" in self.names:
            if name == "word":
                self.rows.append(("".join(self.held), *self.at, *self.blocks[-1]))
                if len(self.rows) > MAX_WORDS:
                    raise Fault(LIMIT)
            elif name == "block":
                self.blocks.pop()

    def declared(self, *given: object) -> None:
        raise Fault(INVALID)

    def doctype(self, _: str, __: str, ___: str, internal: int) -> None:
        if internal:
            raise Fault(INVALID)


def read_boxes(markup: str | None) -> tuple[tuple[float, float], list[tuple]]:
    """Size and word rows of a page's markup; Fault with its code."""
    data = (markup or "").encode("utf-8", "surrogatepass")
    if len(data) > MAX_BYTES:
        raise Fault(LIMIT)
    reader, parser = BoxReader(), expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.begin, reader.end, reader.text
    parser.EntityDeclHandler = parser.SkippedEntityHandler = reader.declared
    parser.StartDoctypeDeclHandler = reader.doctype
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        raise Fault(INVALID) from None
    if reader.size is None:
        raise Fault(INVALID)
    return reader.size, reader.rows


def checked(rows: DataFrame, by: list[str], before: Column | None = None) -> DataFrame:
    """WORD_ROW of rows (by, ordinal, text, BOXES, block, line, page_width, page_height), coordinates made parts of the page.

    `before`: a fault that the row has already. The page's first fault by `ordinal` is its only row.
    """
    page = Window.partitionBy(*by)
    so_far = page.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    is_word = F.col("text").isNotNull()
    fits = lambda low, high, size: F.coalesce((F.col(low) >= 0) & (F.col(low) < F.col(high)) & (F.col(high) <= F.col(size)), F.lit(False))
    plain = F.char_length("text").between(1, MAX_WORD) & ~F.col("text").rlike(ODD_CHARACTER)
    own = F.when(is_word & ~plain, UNVERIFIED).when(is_word & ~(fits("left", "right", "page_width") & fits("top", "bottom", "page_height")), INVALID)
    limits = F.when(F.count("text").over(so_far) > MAX_WORDS, LIMIT)
    told = rows.withColumn("fault", F.coalesce(*([] if before is None else [before]), own, limits))
    first = F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal"))).over(page)
    over = F.when(F.sum(F.char_length("text")).over(page) > MAX_CHARS, LIMIT)
    told = told.withColumns({"fault": F.coalesce(first, over), "_place": F.row_number().over(page.orderBy("ordinal"))})
    bad = F.col("fault").isNotNull()
    kept = told.where((bad & (F.col("_place") == 1)) | (~bad & is_word))
    good = lambda c: F.when(~bad, c)
    place = good(F.row_number().over(page.orderBy("ordinal")) - 1).cast("int")
    parts = {b: good(F.col(b) / F.col("page_width" if b in ("left", "right") else "page_height")) for b in BOXES}
    return kept.select(*by, "fault", place.alias("ordinal"), good(F.col("text")).alias("text"), *[c.alias(b) for b, c in parts.items()], *[good(F.col(c)).cast("int").alias(c) for c in ("block", "line")])


def markup_words(pages: DataFrame, by: list[str], markup: str = "markup") -> DataFrame:
    """`by` and WORD_ROW of the words in each page's box markup. A null markup is invalid; a page without words gives
    no rows; pages that share `by` are one page."""
    ship(pages.sparkSession)
    keys = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in by)
    out = f"{keys}, before string, ordinal int, text string, left double, top double, right double, bottom double, block int, line int, page_width double, page_height double"
    names = [*by, "before", "ordinal", "text", *BOXES, "block", "line", "page_width", "page_height"]

    types = [pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_types, found = [*[f.type for f in batch.schema][: len(by)], *types], []
            sent = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), all_types, strict=True)], names=names)  # noqa: B023, E731
            for *key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    size, rows = read_boxes(text)
                    found += [(*key, None, i, *r, *size) for i, r in enumerate(rows)]
                except Fault as e:
                    found.append((*key, str(e), 0, *[None] * 9))
                if len(found) >= MAX_WORDS:
                    yield sent()
                    found = []
            if found:
                yield sent()

    return checked(spread(pages.select(*by, F.col(markup).alias("_markup")), *by).mapInArrow(read, out), by, F.col("before"))


def tsv_words(pages: DataFrame, by: list[str], tsv: str = "tsv", width: str = "pixel_width", height: str = "pixel_height") -> DataFrame:
    """`by` and WORD_ROW of the words in each page's tab-separated rows, column expressions only.

    Blocks and lines are numbered anew, in the order in which they first appear. A header other than TSV_COLUMNS, a second
    page or none, a word number given twice, and numbers that are none are faults. Null texts are invalid.
    """
    # Pages are dealt out whole, so no window over a page or a part of it needs another shuffle.
    text = F.coalesce(F.col(tsv), F.lit(""))
    dealt = spread(pages.select(*by, *dict.fromkeys((tsv, width, height))), *by)
    lines = dealt.select(*by, F.col(width).cast("double").alias("page_width"), F.col(height).cast("double").alias("page_height"), (F.octet_length(text) > MAX_BYTES).alias("large"), F.posexplode(F.split(text, "\r?\n")).alias("ordinal", "row"))
    lines = lines.where((F.col("ordinal") == 0) | (F.col("row") != "")).withColumn("c", F.split("row", "\t"))
    whole = lambda i: F.when(F.get("c", F.lit(i)).rlike(r"^[+-]?\d{1,9}$"), F.get("c", F.lit(i))).try_cast("int")
    real = lambda i: F.get("c", F.lit(i)).try_cast("double")
    named = {n: whole(i) for i, n in enumerate(TSV_COLUMNS[:6])} | {n: real(i) for i, n in enumerate(TSV_COLUMNS) if 6 <= i < 10}
    head = F.col("ordinal") == 0
    rows = lines.select(*by, "ordinal", "page_width", "page_height", "large", (F.col("row") != "\t".join(TSV_COLUMNS)).alias("other"), F.size("c").alias("n"), *[c.alias(f"x_{n}") for n, c in named.items()], F.get("c", F.lit(11)).alias("x_text"))
    of = lambda n: F.col(f"x_{n}")
    is_word = ~head & (of("level") == 5) & (F.col("x_text") != "")
    page = Window.partitionBy(*by)
    numbers = ("block_num", "par_num", "line_num", "word_num")
    first = lambda *more: F.min(F.when(is_word, F.col("ordinal"))).over(Window.partitionBy(*by, *[of(m) for m in more]))
    rows = rows.withColumns({"word": F.coalesce(is_word, F.lit(False)), "of_block": first("block_num", "par_num"), "of_line": first("block_num", "par_num", "line_num"), "again": F.row_number().over(Window.partitionBy(*by, F.coalesce(is_word, F.lit(False)), *[of(n) for n in numbers]).orderBy("ordinal")) > 1})
    rows = rows.withColumns({"block": F.dense_rank().over(page.orderBy(F.col("of_block").asc_nulls_last())), "line": F.dense_rank().over(Window.partitionBy(*by, "x_block_num", "x_par_num").orderBy(F.col("of_line").asc_nulls_last())), "pages": F.sum(F.when(~head & (of("level") == 1), 1).otherwise(0)).over(page)})
    holds = lambda c: F.coalesce(c, F.lit(False))
    page_box = (of("left") == 0) & (of("top") == 0) & (of("width") == F.col("page_width")) & (of("height") == F.col("page_height"))
    numbered = F.lit(True)
    for n in numbers:
        numbered = numbered & of(n).between(1, MAX_WORDS)
    before = (
        F.when(F.col("large"), LIMIT)
        .when(head & F.col("other"), INVALID)
        .when(head & (F.col("pages") != 1), INVALID)
        .when(~head & ((F.col("n") > len(TSV_COLUMNS)) | (F.col("ordinal") > MAX_WORDS * ROWS_A_WORD)), LIMIT)
        .when(~head & ~holds(of("level").between(1, 5) & (of("page_num") == 1)), INVALID)
        .when(~head & (of("level") == 1) & ~holds(page_box), INVALID)
        .when(F.col("word") & (F.col("again") | ~holds(numbered)), INVALID)
    )
    only = lambda c: F.when(F.col("word"), c)
    ready = rows.select(*by, "ordinal", "page_width", "page_height", before.alias("before"), only(F.col("x_text")).alias("text"), of("left").alias("left"), of("top").alias("top"), (of("left") + of("width")).alias("right"), (of("top") + of("height")).alias("bottom"), "block", "line")
    return checked(ready, by, F.col("before"))


def mapping_verified(info: Column, ordinal: Column, width: Column, height: Column, pixel_width: Column, pixel_height: Column) -> Column:
    """Whether a page's rendering maps to its file without a shift: both boxes are one that begins at 0, nothing is
    turned, sizes agree as displayed, and the picture has the pixels of DOTS an inch. False for what isn't told."""
    number = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
    found = lambda pattern: F.regexp_substr(F.coalesce(info, F.lit("")), pattern)
    box = lambda label: F.split(F.regexp_replace(found(F.concat(F.lit(r"(?m)^(?:Page\s+"), ordinal.cast("string"), F.lit(rf"\s+)?{label}:\s*{number}(?:\s+{number}){{3}}\s*$"))), rf"^.*{label}:\s*|\s+$", ""), r"\s+")
    turned = F.regexp_extract(found(F.concat(F.lit(r"(?m)^Page(?:\s+"), ordinal.cast("string"), F.lit(r")?\s+rot:\s*-?\d+\s*$"))), r"(-?\d+)\s*$", 1)
    media, crop = (F.transform(box(x), lambda v: v.try_cast("double")) for x in ("MediaBox", "CropBox"))
    shown = lambda a, b: F.format_string("%.2f", a) == F.format_string("%.2f", b.cast("double"))
    pixels = lambda n, size: n == F.ceil(size * DOTS / POINTS)
    same = (media == crop) & (F.get(media, F.lit(0)) == 0) & (F.get(media, F.lit(1)) == 0) & shown(F.get(media, F.lit(2)), width) & shown(F.get(media, F.lit(3)), height)
    return F.coalesce((turned.try_cast("int") == 0) & same & pixels(pixel_width, width) & pixels(pixel_height, height), F.lit(False))


def word_text(words: DataFrame, by: list[str]) -> DataFrame:
    """`by` and text: words in lines, lines in blocks, each in the order in which they begin."""
    line = words.groupBy(*by, "block", "line").agg(F.min("ordinal").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda w: w["text"]), " ").alias("text"))
    joined = lambda rows, keys, gap: rows.groupBy(*keys).agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda w: w["text"]), gap).alias("text"))
    return joined(joined(line, [*by, "block"], "\n"), by, "\n\n").drop("at")
