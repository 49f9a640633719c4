"""Recognizers: a registry of patterns and rules, and the Arrow function that finds their spans in chunks of text.

Java's and Python's patterns differ in what counts as a word or a space beyond ASCII, and Spark returns no positions, so
spans are found by Python's `re` in Arrow batches, after a native prefilter that no span can pass by.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def _dihedral() -> list[list[int]]:
    """Products in the symmetry group of the pentagon: 0-4 turn, 5-9 turn and flip."""
    return [[(i + j) % 5 if i < 5 and j < 5 else (i + j) % 5 + 5 if i < 5 else (i - j) % 5 + 5 if j < 5 else (i - j) % 5 for j in range(10)] for i in range(10)]


def _powers() -> list[list[int]]:
    """The checksum's permutation, applied 0 to 7 times."""
    rows, step = [list(range(10))], (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    while len(rows) < 8:
        rows.append([step[x] if len(rows) == 1 else rows[1][x] for x in rows[-1]])
    return rows


DIHEDRAL, POWERS = _dihedral(), _powers()


def verhoeff(digits: str) -> bool:
    check = 0
    for i, d in enumerate(reversed(digits)):
        check = DIHEDRAL[check][POWERS[i % 8][int(d)]]
    return check == 0


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def aadhaar_like(m: re.Match) -> bool:
    digits = re.sub("[ -]", "", m.group())
    return len(set(digits)) > 1 and verhoeff(digits)


def has_digit(group: int) -> Callable[[re.Match], bool]:
    return lambda m: any(c.isdigit() for c in m.group(group))


@dataclass(frozen=True)
class Recognizer:
    """Spans of `group` of `pattern` where `accept` holds. `name` may depend on the match.

    `unless_inside`: no span if one of an earlier recognizer covers the whole match. `unless_overlaps`: no span if one
    of the same kind overlaps. Recognizers run in order, which is part of the result.
    """

    name: str | Callable[[re.Match], str]
    pattern: re.Pattern
    confidence: float
    reason: str
    group: int = 0
    accept: Callable[[re.Match], bool] = lambda m: True
    unless_inside: bool = False
    unless_overlaps: bool = False


RULES: tuple[Recognizer, ...] = (
    Recognizer("IN_AADHAAR", P.AADHAAR, 0.96, "format_and_verhoeff_checksum", accept=aadhaar_like),
    Recognizer("IN_PAN", P.PAN, 0.9, "pan_format_candidate"),
    Recognizer("ABHA", P.ABHA, 0.88, "abha_format_and_label_candidate", group=1),
    Recognizer("ABHA_ADDRESS", P.ABHA_ADDRESS, 0.9, "abha_address_format_candidate"),
    Recognizer("INSURANCE_ID", P.INSURANCE, 0.85, "insurance_identifier_label_and_format", group=1, accept=has_digit(1)),
    Recognizer(lambda m: "UHID" if m.group(1).lower() == "uhid" else "MRN", P.HOSPITAL_ID, 0.9, "hospital_identifier_label_and_format", group=2, accept=has_digit(2)),
    Recognizer("EMAIL_ADDRESS", P.EMAIL, 0.95, "email_format"),
    Recognizer("PHONE_NUMBER", P.PHONE, 0.75, "indian_phone_format_candidate", unless_inside=True),
    Recognizer("DATE_OF_BIRTH", P.BIRTH, 0.9, "birth_date_label_and_format", group=1),
)
#: An extension: card numbers by length and checksum. No names of persons or places are found without a model.
CARDS = Recognizer("CREDIT_CARD", P.CARD, 0.6, "card_number_checksum", accept=lambda m: luhn(re.sub("[ -]", "", m.group())), unless_overlaps=True)
HEALTH = "HEALTH_INFORMATION"
IDENTIFIERS = ("MRN", "UHID", "ABHA", "ABHA_ADDRESS")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("anchor", T.StringType()), T.StructField("value", T.StringType()), T.StructField("excerpt", T.StringType())])


def anchor_of(kind: str, before: str, value: str, document: bool) -> str | None:
    """Kind and value, in normal form C, of a span that identifies its record's patient.

    Flat text: identifiers do, names and Aadhaar numbers only right after a patient's label. Regions of a document:
    what stands before the span in its line must be the field's label and nothing else.
    """
    if document:
        label = re.split("[\r\n]", before)[-1].strip()
        ok = kind in P.DOCUMENT_LABELS and re.fullmatch(P.DOCUMENT_LABELS[kind] + P.LABEL_END + "[\"']?", label, re.I)
    else:
        reach = before[-P.LABEL_REACH :]
        ok = kind in IDENTIFIERS or (kind == "PERSON" and P.PERSON_LABEL.search(reach)) or (kind == "IN_AADHAAR" and P.AADHAAR_LABEL.search(reach))
    return f"{kind}\0{unicodedata.normalize('NFC', value)}" if ok else None


def spans_of(chunk: str, offset: int, more: bool, before: str, after: str, rules: tuple[Recognizer, ...], document: bool = False, evidence: bool = False) -> list[tuple]:
    """SPANs of a chunk that starts at `offset` of its segment, in places of the segment.

    `before` and `after` are what surrounds the chunk there. A span that touches a cut is left to the neighbour, which
    sees it whole.
    """
    found: dict[tuple[str, int, int], tuple[float, str, int]] = {}

    def cut(s: int, e: int) -> bool:
        return (offset > 0 and s == 0) or (more and e == len(chunk))

    for rank, r in enumerate(rules):
        for m in r.pattern.finditer(chunk):
            if not r.accept(m):
                continue
            s, e = m.span(r.group)
            kind = r.name if isinstance(r.name, str) else r.name(m)
            if r.unless_inside and any(a <= m.start() and b >= m.end() for _, a, b in found):
                continue
            if r.unless_overlaps and any(k == kind and a < e and b > s for k, a, b in found):
                continue
            if not cut(s, e):
                found[kind, s, e] = r.confidence, r.reason, rank
    for m in P.HEALTH.finditer(chunk):
        if not cut(*m.span()):
            found[HEALTH, *m.span()] = 0.7, P.REASON_DEFAULT, len(rules)
    around = before + chunk + after
    out = []
    for (kind, s, e), (confidence, reason, rank) in found.items():
        at = len(before) + s
        anchor = anchor_of(kind, around[:at], chunk[s:e], document) if kind != HEALTH else None
        shown = (chunk[s:e][: P.VALUE_CHARS], around[max(0, at - P.EXCERPT_BEFORE) :][: P.EXCERPT_CHARS]) if evidence else (None, None)
        out.append((kind, s + offset, e + offset, confidence, reason, rank, anchor, *shown))
    return out


def span_udf(rules: tuple[Recognizer, ...] = RULES, document: bool = False, evidence: bool = False) -> Callable[..., Column]:
    def find(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        names = SPAN.fieldNames()
        for chunks, offsets, more, before, after in batches:
            yield pd.Series([[dict(zip(names, s, strict=True)) for s in spans_of(c, int(o), bool(m), b, a, rules, document, evidence)] for c, o, m, b, a in zip(chunks, offsets, more, before, after, strict=True)], index=chunks.index, dtype=object)

    find.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(find, T.ArrayType(SPAN))


#: Every rule needs a digit or an @, or a term of the clinical vocabulary.
def may_match(text: Column) -> Column:
    return text.rlike(r"[\p{Nd}@]") | text.rlike("(?iU)" + P.HEALTH.pattern)
