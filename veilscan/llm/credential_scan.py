"""Secret scan: patterns that stand alone, and weak parts of credentials that count only together.

A credential often comes in parts: an access identifier, a secret, an endpoint. A part that could be anything by itself
is reported where complementary parts share its scope: a stretch of `SCOPE` characters around it that no blank line
ends. Parts of a document are sorted, and each is joined to the nearest complementary ones before and after it by
bisection: if those are out of its scope, so are all others. Only the part's own span is emitted, never all pairs, so the
time is n log n in the parts of a document.

Parts are: identifiers (named ones, and e-mail addresses as login names), secrets (named ones, and lone tokens of high
entropy) and endpoints (addresses with a scheme, named hosts, and IP addresses).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, ship, table, tidy

Span = tuple[str, int, int]

#: Order of kinds at the same start: first those that stand alone, then those found by linking.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "identifier", "secret", "endpoint")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Characters before and after a part within which complementary parts count.
SCOPE = 240
#: A lone token is a candidate secret from this length and this entropy (bits a character) on, with letters of both
#: cases and digits.
MIN_TOKEN, MIN_ENTROPY = 20, 3.5

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"""(?i:client|account|app|tenant|access[_-]?key|key|user)[_-]?(?i:id|name)\b["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII)
WEAK_SECRET = re.compile(r"""(?i:pwd|pass(?:phrase)?|auth|credential|private[_-]?key|signature|sas)\b["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=~!@%-]{6,})""", re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
ADDRESS = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?!\.?[0-9])")
ENDPOINT = re.compile(r"""(?i:https?|ftp|s3|jdbc:[a-z]+|amqp|redis|postgres(?:ql)?|mysql|mongodb)://[^\s"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""", re.ASCII)
BLANK = re.compile(r"\n[ \t\r]*\n")


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def base_spans(text: str) -> list[Span]:
    """The kinds that stand alone: leftmost, non-overlapping within a kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]  # runs are matched whole, so shorter ones can't matter
    return found


class Spans:
    """Intervals by their starts, with the greatest end among those up to each."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.reach = list(accumulate((e for _, e in self.spans), max))

    def before(self, at: int) -> int | None:
        """The greatest end of those that start before `at`."""
        i = bisect_left(self.starts, at)
        return self.reach[i - 1] if i else None

    def after(self, at: int) -> int | None:
        """The least start from `at` on."""
        i = bisect_left(self.starts, at)
        return self.starts[i] if i < len(self.starts) else None

    def meets(self, s: int, e: int) -> bool:
        end = self.before(e)
        return end is not None and end > s


def weak_parts(text: str, base: list[Span]) -> dict[str, list[tuple[int, int]]]:
    """Candidates outside the spans of `base`. A lone token or address that is within another part is none of its own."""
    taken = Spans((s, e) for _, s, e in base)
    found = lambda pattern, but: [m.span() for m in pattern.finditer(text) if not any(x.meets(*m.span()) for x in but)]
    parts: dict[str, list[tuple[int, int]]] = {"identifier": [], "secret": [], "endpoint": []}
    marks = ":" in text or "=" in text
    if marks:
        parts["secret"] = found(WEAK_SECRET, [taken])
    tokens = [(s, e) for s, e in found(TOKEN, [taken]) if secret_like(text[s:e])]
    if not tokens and not parts["secret"] and all(k == "access" for k, _, _ in base):
        return parts  # nothing that the others could complement
    if marks:
        parts |= {"identifier": found(IDENTIFIER, [taken]), "endpoint": found(ENDPOINT, [taken])}
    named = Spans(p for ps in parts.values() for p in ps)
    if "@" in text:
        parts["identifier"] += found(EMAIL, [taken, named])
    parts["endpoint"] += found(ADDRESS, [taken, named])
    named = Spans(p for ps in parts.values() for p in ps)
    parts["secret"] += [t for t in tokens if not named.meets(*t)]
    return parts


def secret_like(token: str) -> bool:
    return bool(re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)) and entropy(token) >= MIN_ENTROPY


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts with complementary ones in their scope.

    A weak secret needs an identifier or an endpoint; an identifier or endpoint needs a secret, and what stands alone
    counts for either side: an access identifier as identifier, the others as secrets.
    """
    weak = weak_parts(text, base)
    if not any(weak.values()):
        return []
    secrets = Spans(weak["secret"] + [(s, e) for k, s, e in base if k != "access"])
    partners = Spans(weak["identifier"] + weak["endpoint"] + [(s, e) for k, s, e in base if k == "access"])
    if not secrets.spans or not partners.spans:
        return []
    blanks = [m.start() for m in BLANK.finditer(text)]
    # Parts hold no line ends, so what lies between two of them decides.
    near = lambda a, b: b - a <= SCOPE and bisect_left(blanks, a) == bisect_left(blanks, b)

    def meets(part: tuple[int, int], others: Spans) -> bool:
        s, e = part
        end, start = others.before(e), others.after(e)
        return (end is not None and (end > s or near(end, s))) or (start is not None and near(e, start))

    found = [("secret", *p) for p in weak["secret"] if meets(p, partners)]
    return found + [(k, *p) for k in ("identifier", "endpoint") for p in weak[k] if meets(p, secrets)]


def all_spans(text: str | None) -> list[Span]:
    """Base and linked spans by start, then kind, then end. A null text counts as empty and has none."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with every span, and what overlaps it, replaced by one mark."""
    if not text:
        return text
    out, at = [], 0
    for _, s, e in all_spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(SPANS)
def spans_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t)] for t in batch], index=batch.index, dtype=object)


@F.pandas_udf(T.StringType())
def redact_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([redacted(t) for t in batch], index=batch.index, dtype=object)


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with an array of (kind, start, end) in code points, end exclusive; empty where nothing is found.

    Every row is scanned whole and by itself, so nothing is shuffled and rows may repeat. Null and empty texts have no
    spans, an empty table gives no rows. A column `out` is replaced, whatever its case; names that differ in case only
    are refused (ValueError).
    """
    ship(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in kept_columns(docs, out)], spans_udf(F.col(f"`{text}`")).alias(out))


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """`docs` with secrets replaced in the text and `n_chars` set to what is left; null texts stay null.

    Rows may repeat, other columns stay as they are, and a table without `n_chars` gets none. Names that differ in case
    only are refused (ValueError).
    """
    ship(docs.sparkSession)
    kept_columns(docs)
    cleaned = docs.withColumn(text, redact_udf(F.col(text)))
    return cleaned.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else cleaned


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans and all spans of every row of `documents`. Null and empty texts have none;
    repeated rows each give a row; an empty table gives none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
