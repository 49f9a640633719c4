"""Native column functions over text: kinds of structure, segments, windows, locations and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def structured_kind(text: Column) -> Column:
    """`json` or `xml` if the text is one standing alone, else null."""
    start = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", "")
    return F.when(start.rlike(r"^[{\[]"), "json").when(start.rlike(r"(?U)^<(?:\?xml\b|[A-Za-z_][\w:.-]*(?:[\s\x1c-\x1f]|>|/))"), "xml")


def lines_of(text: Column) -> Column:
    """Lines without their ends; no last empty one."""
    parts = F.split(text, P.LINE_SPLIT, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def segments(text: Column, single: bool = False) -> Column:
    """array<struct<segment, text>>: pages at form feeds, blocks at record boundaries, rows of blocks with tabs.

    Ordinals are from 1 and count empty pieces.
    """
    if single:
        return F.array(F.struct(F.lit("record").alias("segment"), text.alias("text")))

    def rows(page: Column, i: Column) -> Column:
        def cells(block: Column, j: Column) -> Column:
            parts = F.when(F.contains(block, F.lit("\t")), lines_of(block)).otherwise(F.array(block))
            name = lambda k: F.format_string("segment:%d/block:%d/row:%d", i + 1, j + 1, k + 1)
            return F.transform(parts, lambda row, k: F.struct(name(k).alias("segment"), row.alias("text")))

        return F.flatten(F.transform(F.split(page, "(?iU)" + P.RECORD_BOUNDARY, -1), cells))

    return F.flatten(F.transform(F.split(text, "\f", -1), rows))


def windows(text: Column) -> Column:
    """Offsets of the overlapping windows over a segment; none for an empty one."""
    n = F.char_length(text)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(P.STRIDE))).otherwise(F.array().cast("array<int>"))


def location(*parts: Column) -> Column:
    """Components joined by `/`, each percent-encoded, so that a slash within one stays apart."""
    encoded = [F.replace(F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")) for p in parts]
    return F.concat_ws("/", *encoded)


def object_key(place: Column) -> Column:
    return F.sha2(place, 256)


def csv_guard(value: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe; null prints as None."""
    shown = F.coalesce(value.cast("string"), F.lit("None"))
    return F.when(F.ltrim(shown).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), shown)).otherwise(shown)


def same_etag(a: Column, b: Column) -> Column:
    plain = lambda x: F.regexp_replace(x, '^"(.*)"$', "$1")
    return F.coalesce(plain(a) == plain(b), F.lit(False))


def bounded(text: Column, maximum: int) -> tuple[Column, Column, Column]:
    """Text, status and reason after cutting at `maximum` characters."""
    over = F.char_length(text) > maximum
    return F.substring(text, 1, maximum), F.when(over, "partial").otherwise("full"), F.when(over, "text_limit_reached")
