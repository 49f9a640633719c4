"""Text to findings: segments, windows, spans, linkage to a patient, and the merged findings of each object.

The whole is one plan with two shuffles: windows are dealt to all tasks, so a giant text is searched by many, and what
they find goes by object and is deduplicated, linked within its segment and merged on that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import ship, spread
from ..functions import patterns as P
from ..functions.recognizers import HEALTH, IDENTIFIERS, RULES, Recognizer, may_match, span_udf
from ..functions.structured import render_udf
from ..functions.text import segments, structured_kind, windows

FINDING = ("object", "entity_type", "classification", "confidence", "match_count", "reason", "segment")


@dataclass(frozen=True)
class Context:
    """Columns of what surrounds a text, where it is the cell of a table or a region of a document.

    `column`: name of the cell's column. `references`: array<struct<kind, value>> of the row's patient columns.
    `ambiguous`, `unverified`: booleans. `document`: whether texts are single records of a page's regions.
    """

    column: str | None = None
    references: str | None = None
    ambiguous: str | None = None
    unverified: str | None = None
    document: bool = False

    def of(self, name: str, default: Column) -> Column:
        given = getattr(self, name)
        return F.col(given) if given else default


def spans(texts: DataFrame, key: str, text: str, context: Context = Context(), rules: tuple[Recognizer, ...] = RULES, evidence: bool = False, prefilter: bool = True) -> DataFrame:
    """A row for each distinct span: object, segment and SPAN, with the context's columns.

    A text that stands for clinical content by its column's name gives a span from -1 to -1 for each segment. Texts
    without any possible match are passed over natively; `prefilter` must be off for recognizers that need neither digit
    nor @. Null and empty texts have no spans.
    """
    ship(texts.sparkSession)
    none = F.array().cast("array<struct<kind:string,value:string>>")
    base = texts.select(
        F.col(key).alias("object"), F.coalesce(F.col(text), F.lit("")).alias("t"), context.of("column", F.lit(None).cast("string")).alias("column"), F.coalesce(context.of("references", none), none).alias("refs"),
        F.coalesce(context.of("ambiguous", F.lit(False)), F.lit(False)).alias("ambiguous"), F.coalesce(context.of("unverified", F.lit(False)), F.lit(False)).alias("unverified"),
    )
    clinical = F.coalesce(F.col("column").rlike(P.CLINICAL_COLUMN), F.lit(False))
    if prefilter:
        base = base.where(may_match(F.col("t")) | (clinical & (F.trim("t") != "")))
    if context.document:
        pieces = base.withColumn("inner", F.lit(False))
    else:
        # Serialized records hold several people: the row's references say nothing about them.
        kind = structured_kind(F.col("t"))
        pieces = base.withColumn("kind", kind).withColumn("r", render_udf()(F.when(F.col("kind").isNotNull(), F.col("t")), F.col("kind")))
        pieces = pieces.withColumns({"t": F.coalesce("r.text", "t"), "inner": F.col("kind").isNotNull()}).drop("kind", "r")
        pieces = pieces.withColumns({"refs": F.when(F.col("inner"), none).otherwise(F.col("refs")), "ambiguous": F.col("ambiguous") & ~F.col("inner")})
    pieces = pieces.withColumn("s", F.explode(segments(F.col("t"), context.document))).select("object", "column", "refs", "ambiguous", "unverified", F.col("s.segment").alias("segment"), F.col("s.text").alias("s"))
    chunks = pieces.withColumn("o", F.explode(windows(F.col("s"))))
    cut = lambda at, n: F.substring(F.col("s"), at, n)
    before = F.lit(2_000) if context.document else F.lit(P.LABEL_REACH)
    chunks = chunks.withColumns({
        "chunk": cut(F.col("o") + 1, F.lit(P.WINDOW)), "more": F.col("o") + P.WINDOW < F.char_length("s"),
        "before": cut(F.greatest(F.lit(1), F.col("o") + 1 - before), F.least(F.col("o"), before)), "after": cut(F.col("o") + 1 + P.WINDOW, F.lit(P.EXCERPT_CHARS)) if evidence else F.lit(""),
    }).where("trim(chunk) <> ''")
    # Patterns cost more time than their texts have bytes, and a table of one file is one task.
    chunks = spread(chunks.select("object", "segment", "column", "refs", "ambiguous", "unverified", "o", "chunk", "more", "before", "after"), "object", "segment", "o")
    found = span_udf(rules, context.document, evidence)(F.col("chunk"), F.col("o"), F.col("more"), F.col("before"), F.col("after"))
    by_name = F.when(clinical & (F.col("o") == 0), F.array(F.struct(F.lit(HEALTH).alias("kind"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), F.lit(0.7).alias("confidence"), F.lit(P.REASON_DEFAULT).alias("reason"), F.lit(99).alias("rank"), *[F.lit(None).cast("string").alias(c) for c in ("anchor", "value", "excerpt")])))
    every = F.explode(F.concat("found", F.coalesce("by_name", F.filter("found", lambda x: F.lit(False)))))
    rows = chunks.withColumns({"found": found, "by_name": by_name}).select("object", "segment", "refs", "ambiguous", "unverified", "o", every.alias("x"))
    rows = rows.select("object", "segment", "refs", "ambiguous", "unverified", "o", "x.*").repartition("object")
    # Overlapping windows see the same span twice; what follows keeps to the partitioning by object.
    return rows.groupBy("object", "segment", "kind", "start", "end").agg(F.min("o").alias("o"), *[F.min(c).alias(c) for c in ("confidence", "reason", "rank", "anchor", "value", "excerpt")], F.first("refs").alias("refs"), F.max("ambiguous").alias("ambiguous"), F.max("unverified").alias("unverified"))


def linked(found: DataFrame) -> DataFrame:
    """Findings of each segment, clinical ones decided by the patients that the segment names.

    Whether there are none, one or more needs the least and the greatest only, so no set is gathered. Explicit
    identifiers come before names; a row's reference that repeats an explicit value is the same patient.
    """
    person = F.col("anchor").startswith("PERSON\0")
    groups = found.groupBy("object", "segment", "kind", "reason").agg(
        F.max("confidence").alias("confidence"), F.sum(F.when(F.col("start") >= 0, 1).otherwise(0)).alias("n"), F.max(F.col("start") < 0).alias("named"), F.sum(F.when((F.col("start") >= 0) & (F.col("o") == 0), 1).otherwise(0)).alias("first_chunk"),
        F.min(F.when(~person, F.col("anchor"))).alias("low"), F.max(F.when(~person, F.col("anchor"))).alias("high"), F.min(F.when(person, F.col("anchor"))).alias("p_low"), F.max(F.when(person, F.col("anchor"))).alias("p_high"),
        F.first("refs").alias("refs"), F.max("ambiguous").alias("ambiguous"), F.max("unverified").alias("unverified"),
    )
    w = Window.partitionBy("object", "segment")
    groups = groups.withColumns({c: F.min(c).over(w) if "low" in c else F.max(c).over(w) for c in ("low", "high", "p_low", "p_high")})
    outer = F.array_distinct(F.transform("refs", lambda r: F.concat(r["kind"], F.lit("\0"), r["value"])))
    explicit = F.array_distinct(F.filter(F.concat(F.array("low", "high"), F.filter(outer, lambda r: ~r.startswith("PATIENT_REFERENCE\0"))), lambda x: x.isNotNull()))
    value = lambda x: F.substring_index(x, "\0", -1)
    schema = F.filter(outer, lambda r: r.startswith("PATIENT_REFERENCE\0") & ~F.exists(explicit, lambda e: value(e) == value(r)))
    ids = F.size(explicit) + F.size(schema)
    names = F.when(F.col("p_low").isNull(), 0).when(F.col("p_low") == F.col("p_high"), 1).otherwise(2)
    groups = groups.withColumn("patients", F.when(ids > 0, ids).otherwise(names))
    many, health = (F.col("patients") > 1) | F.col("ambiguous"), F.col("kind") == HEALTH
    is_linked = ~many & ~F.col("unverified") & (F.col("patients") == 1)
    return groups.select(
        "object", F.col("kind").alias("entity_type"), F.when(~health, P.PERSONAL).when(is_linked, P.LINKED).otherwise(P.CLINICAL).alias("classification"),
        F.when(health & is_linked, 0.85).otherwise(F.col("confidence")).alias("confidence"), F.when(health & F.col("named") & (F.col("first_chunk") == 0), F.col("n") + 1).otherwise(F.col("n")).cast("long").alias("match_count"),
        F.when(~health, F.col("reason")).when(F.col("unverified"), P.REASON_UNVERIFIED).when(many, P.REASON_AMBIGUOUS).when(is_linked, P.REASON_LINKED).otherwise(P.REASON_DEFAULT).alias("reason"), "segment",
    )


def detect(texts: DataFrame, key: str, text: str, context: Context = Context(), rules: tuple[Recognizer, ...] = RULES) -> DataFrame:
    """Findings of `texts`: a row for each object, type, class, reason and segment. No matched values are in them."""
    return linked(spans(texts, key, text, context, rules))


def evidence(texts: DataFrame, key: str, text: str, context: Context = Context(), rules: tuple[Recognizer, ...] = RULES) -> DataFrame:
    """At most three examples for each object, segment, type and reason, in the order of the text."""
    found = spans(texts, key, text, context, rules, evidence=True).where("start >= 0")
    w = Window.partitionBy("object", "segment", "kind", "reason").orderBy("o", "rank", "start")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= P.EXAMPLES).select("object", F.col("kind").alias("entity_type"), "reason", "segment", F.col("n").alias("example"), "value", "excerpt", "start", "end")


def merged(findings: DataFrame, *by: str) -> DataFrame:
    """Findings summed over segments: counts added, the highest confidence kept."""
    return findings.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.sum("match_count").alias("match_count"))


__all__ = ["FINDING", "IDENTIFIERS", "Context", "detect", "evidence", "linked", "merged", "spans"]
