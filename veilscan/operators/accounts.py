"""What a page reader says it did with a document, made up again from its own rows: what was covered, and what it holds.

An account is JSON: a claim about the whole, and a row for each page or frame. It is kept as VARIANT, so a number is told
from a text that looks like one, and null from nothing. No total in it is believed: a fold over the rows gives the sums
anew, and an account whose claims differ from them is refused with a code. Words of pages with verified geometry are
checked as rows of pages, and both channels of a page are reconciled over all documents at once.

Codes of an account come in this order: the claim, its rows by ordinal, the sums, geometry by ordinal, kinds of content.
An account that names a key twice is no JSON here, and is refused as such.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import durable, ship
from . import channels as C

# Names of protocols, limits of an account and of the words in it.
PROTOCOL, FEATURE_PROTOCOL, READER = "parser-accounting/v1", "pdf-features/v1", "isolated_page_ocr"
MAX_TEXT, MAX_TOTAL, MAX_UNITS, MAX_PIXELS, MAX_FEATURES, MAX_VIEW = 1_000_000, 1_000_000, 100, 20_000_000, 200_000, 300_000
MAX_WORD, MAX_WORDS, MAX_WORD_CHARS, MAX_PLACE = 4096, 10_000, 250_000, 1_000_000

# What may be said of a unit.
RENDERED = ("not_attempted", "completed", "failed")
READ = ("not_attempted", "completed", "failed", "limited")
WITH_TEXT = ("completed", "limited")
GEOMETRY_REASONS = ("verified", "mapping_unverified", "channel_incomplete", "geometry_unavailable", "geometry_invalid", "geometry_text_unverified", "geometry_limit")

# Reasons that a reader may give; any other is reported as OTHER_REASON. The second list has those that say
# nothing about the pages of a PDF.
REASONS = (
    "input_size_limit", "input_unavailable", "input_changed", "page_limit", "pixel_limit", "text_limit", "job_timeout", "processing_timeout", "job_interrupted", "dependency_unavailable",
    "output_limit", "process_failed", "image_stage_failed", "unsupported_kind", "unsupported_pdf_header", "page_dimensions_unavailable", "render_output_invalid", "pdf_inventory_failed",
    "pdf_encrypted", "unsupported_image_format", "image_inventory_failed", "inventory_unavailable", "inventory_invalid", "invalid_image", "render_failed", "ocr_invalid_utf8",
    "nonvisual_content_present", "inventory_failed", "encrypted_pdf", "image_dependency_unavailable", "processing_failed", "invalid_request", "image_render_failed", "unit_render_failed",
    "pdf_feature_inspection_failed", "pdf_feature_limit", "pdf_page_count_mismatch", "extraction_not_permitted", "native_text_budget_exhausted", "native_invalid_utf8", "native_text_failed",
    "invalid_text_encoding",
)
FEATURE_GAPS, OTHER_REASON = ("pdf_feature_inspection_failed", "pdf_feature_limit"), "worker_reported_incomplete"

# What is counted in a PDF, and which counts are no content beside its pages.
FEATURES = (
    "actions", "annotations", "associated_files", "embedded_name_trees", "embedded_streams", "file_specifications", "forms", "image_resources", "image_uses", "interactive_features", "layers", "metadata",
    "native_text_operations", "nondefault_user_units", "other_text", "parser_warnings", "unknown_annotations", "unknown_streams", "unknown_structure", "unsupported_operators", "unsupported_resources",
    "unused_images", "unverified_image_uses", "xfa",
)
ON_PAGES = ("image_resources", "image_uses", "native_text_operations")

# Codes of refused accounts, and reasons of those that count.
INVALID, NATIVE_INVALID, NATIVE_MIXED, CONTRADICTED, LEGIBILITY = "invalid_accounting", "invalid_native_accounting", "inconsistent_native_accounting", "inconsistent_accounting", "unsupported_legibility_claim"
BAD_CLAIM, BAD_SIZE, BAD_CHANNEL, BAD_LIST = "invalid_document_geometry_claim", "invalid_document_dimensions", "incomplete_document_geometry_channel", "invalid_document_word_inventory"
BAD_WORDS, OTHER_TEXT, TORN_LINE, TOO_MUCH_TEXT, TOO_MANY_WORDS = "invalid_pdf_word_inventory", "pdf_word_text_mismatch", "noncontiguous_pdf_line", "document_text_limit", "document_geometry_limit"
BAD_FEATURES, FEATURES_CONTRADICTED, PAGES_CONTRADICTED = "invalid_pdf_features", "inconsistent_pdf_features", "inconsistent_page_inventory"
REFUSED, UNREAD, UNRESOLVED, UNVERIFIED, UNINSPECTED, CUT = (
    "page_ocr_unavailable_or_invalid_response", "page_or_frame_ocr_incomplete", "pdf_native_ocr_overlap_unresolved", "pdf_native_representation_and_nonpage_coverage_unverified",
    "image_nonvisual_metadata_not_inspected", "text_limit_reached",
)

BLANK = r"(?U)[\s\x1c-\x1f]"
NONE = "NONE"


# Values of a VARIANT, by what they are written as.


def shape(v: Column, path: str = "$") -> Column:
    """BIGINT, STRING, BOOLEAN, VOID (null), ..., or NONE where there is nothing."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(NONE))


def typed(v: Column, path: str, kind: str) -> Column:
    return F.when(shape(v, path) == kind, F.try_variant_get(v, path, kind.lower()))


def whole(v: Column, path: str) -> Column:
    return typed(v, path, "BIGINT")


def flag(v: Column, path: str) -> Column:
    return typed(v, path, "BOOLEAN")


def string(v: Column, path: str) -> Column:
    return typed(v, path, "STRING")


def number(v: Column, path: str) -> Column:
    return F.when(shape(v, path).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def listed(v: Column, path: str) -> Column:
    return F.when(shape(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def absent(v: Column, path: str) -> Column:
    return shape(v, path).isin(NONE, "VOID")


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def first_of(*ladder: tuple[Column, str]) -> Column:
    """The code of the first condition that doesn't hold."""
    return F.coalesce(*[F.when(~holds(condition), code) for condition, code in ladder])


# The claim and its rows.


def unit_row(u: Column) -> Column:
    has = lambda name: shape(u, f"$.{name}") != NONE
    return F.struct(
        whole(u, "$.ordinal").alias("ordinal"), string(u, "$.render_status").alias("render"), string(u, "$.ocr_status").alias("ocr"), string(u, "$.text").alias("text"), flag(u, "$.truncated").alias("truncated"),
        has("native_status").alias("has_native"), string(u, "$.native_status").alias("native"), string(u, "$.native_text").alias("native_text"), has("native_text").alias("has_native_text"), flag(u, "$.native_text_truncated").alias("native_truncated"),
        reduce(lambda a, b: a | b, [has(c) for c in ("geometry_verified", "geometry_reason", "ocr_words", "native_words")]).alias("has_geometry"),
        F.when(has("geometry_verified"), flag(u, "$.geometry_verified")).otherwise(False).alias("verified"), has("geometry_verified").alias("has_verified"),
        F.when(has("geometry_reason"), string(u, "$.geometry_reason")).otherwise("geometry_unavailable").alias("why"),
        absent(u, "$.pixel_width").alias("no_width"), absent(u, "$.pixel_height").alias("no_height"), whole(u, "$.pixel_width").alias("width"), whole(u, "$.pixel_height").alias("height"),
        F.try_variant_get(u, "$.ocr_words", "variant").alias("ocr_words"), F.try_variant_get(u, "$.native_words", "variant").alias("native_words"),
    )


def fold(units: Column, total: Column, native: Column, maximum: int) -> Column:
    """(n, fault, characters, read, native_read) of all rows: the first fault in their order, and sums up to there."""
    zero = lambda name: F.lit(0).cast("long").alias(name)
    length = lambda c: F.coalesce(F.char_length(c), F.lit(0)).cast("long")

    def step(s: Column, u: Column) -> Column:
        n, upto = s["n"] + 1, s["characters"] + length(u["text"])
        both = upto + F.when(native, length(u["native_text"])).otherwise(0)
        said = u["render"].isin(*RENDERED) & u["ocr"].isin(*READ) & ((u["render"] == "completed") | (u["ocr"] == "not_attempted"))
        text = u["text"].isNotNull() & u["truncated"].isNotNull() & (u["ocr"].isin(*WITH_TEXT) | (u["text"] == "")) & (upto <= maximum)
        second = u["native"].isin(*READ) & u["native_text"].isNotNull() & u["native_truncated"].isNotNull() & (u["native"].isin(*WITH_TEXT) | (u["native_text"] == "")) & (both <= maximum)
        fault = F.coalesce(s["fault"], first_of(((u["ordinal"] == n) & (n <= total) & said & text, INVALID), (~native | second, NATIVE_INVALID)))
        one = lambda c: holds(c).cast("long")
        read, native_read = s["read"] + one((u["ocr"] == "completed") & ~u["truncated"]), s["native_read"] + one(native & (u["native"] == "completed") & ~u["native_truncated"])
        return F.struct(n.alias("n"), fault.alias("fault"), both.alias("characters"), read.alias("read"), native_read.alias("native_read"))

    start = F.struct(zero("n"), F.lit(None).cast("string").alias("fault"), zero("characters"), zero("read"), zero("native_read"))
    return F.aggregate(units, start, step)


def features(v: Column) -> tuple[Column, Column]:
    """Of the counts of a PDF's kinds of content: its code or null, and (pages, bare: pages are all there is, texts), null
    where nothing is said of them."""
    status, done, may, bare = string(v, "$.status"), flag(v, "$.inventory_complete"), flag(v, "$.can_extract"), flag(v, "$.ancillary_absent")
    pages, no_pages, locked = whole(v, "$.original_page_count"), absent(v, "$.original_page_count"), flag(v, "$.encrypted")
    counts = F.when(shape(v, "$.feature_counts").startswith("OBJECT"), F.try_variant_get(v, "$.feature_counts", "map<string,variant>"))
    number_of = F.transform_values(counts, lambda _, x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint")))
    names = F.array_sort(F.map_keys(counts)) == F.array(*[F.lit(x) for x in FEATURES])
    sound = (
        (string(v, "$.protocol") == FEATURE_PROTOCOL) & status.isin("completed", "failed", "limited") & done.isNotNull() & may.isNotNull() & bare.isNotNull() & (no_pages | pages.between(1, MAX_UNITS)) & (absent(v, "$.encrypted") | locked.isNotNull())
        & names & F.forall(F.map_values(number_of), lambda x: holds(x.between(0, MAX_FEATURES)))
    )
    complete = holds((status == "completed") & done & ~no_pages)
    beside = F.exists(F.map_values(F.map_filter(number_of, lambda k, _: ~k.isin(*ON_PAGES))), lambda x: x > 0)
    alone = complete & holds(~locked & may) & ~holds(beside)
    code = first_of((sound, BAD_FEATURES), ((done == complete) & (bare == alone), FEATURES_CONTRADICTED))
    told = F.struct(pages.alias("pages"), alone.alias("bare"), F.element_at(number_of, "native_text_operations").alias("texts"))
    nothing = absent(v, "$")
    return F.when(~nothing, code), F.when(~nothing, told)


def claims(reports: DataFrame, doc: str, limit: int) -> DataFrame:
    """(doc, kind, units, ..., fault) of (doc, kind, report): all that needs no words."""
    c = F.col
    v = reports.select(doc, "kind", F.try_parse_json("report").alias("v"))
    flags = ("page_accounting_complete", "limited", "legibility_verified")
    said = v.select(
        doc, "kind", "v", whole(c("v"), "$.original_unit_count").alias("total"), absent(c("v"), "$.original_unit_count").alias("no_total"), listed(c("v"), "$.units").alias("given"), listed(c("v"), "$.reason_codes").alias("codes"),
        flag(c("v"), "$.page_accounting_complete").alias("claimed"), flag(c("v"), "$.limited").alias("limited"), flag(c("v"), "$.nonvisual_content_present").alias("nonvisual"),
    )
    reasons = F.transform("codes", lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    head = first_of(
        (c("kind").isin("pdf", "image") & (string(c("v"), "$.protocol") == PROTOCOL) & (string(c("v"), "$.kind") == c("kind")) & (c("no_total") | c("total").between(1, MAX_TOTAL)) & (F.size("given") <= MAX_UNITS), INVALID),
        (reduce(and_, [flag(c("v"), f"$.{x}").isNotNull() for x in flags]), INVALID), (~flag(c("v"), "$.legibility_verified"), LEGIBILITY),
        ((F.size("codes") <= 100) & F.forall(reasons, lambda x: x.isNotNull()), INVALID),
    )
    said = said.withColumns({"head": head, "reasons": F.array_sort(F.array_distinct(F.transform(reasons, lambda x: F.when(x.isin(*REASONS), x).otherwise(OTHER_REASON))))})
    rows = said.withColumn("units", F.when(c("head").isNull(), F.transform("given", unit_row)))
    spoken = lambda how: how("units", lambda u: u["has_native"])
    rows = rows.withColumn("native", holds((c("kind") == "pdf") & (F.size("units") > 0) & spoken(F.forall)))
    rows = rows.withColumn("sums", fold(c("units"), c("total"), c("native"), limit))
    omitted = c("total") - F.size("units")
    counted = F.when(c("no_total"), absent(c("v"), "$.units_omitted")).otherwise(whole(c("v"), "$.units_omitted") == omitted)
    gaps = F.when(c("kind") == "pdf", F.array_except("reasons", F.array(*[F.lit(x) for x in FEATURE_GAPS]))).otherwise(c("reasons"))
    complete = holds((c("sums.read") == c("total")) & (F.size("units") == c("total")) & (~c("native") | (c("sums.native_read") == c("total"))) & ~c("limited") & (F.size(gaps) == 0))
    rows = rows.withColumns({"omitted": omitted.cast("long"), "complete": complete})
    # Text of a second channel that isn't accounted for still counts against the limit.
    unasked = F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + F.coalesce(F.char_length(u["native_text"]), F.lit(0)))
    beyond = F.when((c("kind") == "pdf") & ~c("native"), ~F.exists("units", lambda u: u["has_native_text"] & u["native_text"].isNull()) & (c("sums.characters") + unasked <= limit)).otherwise(True)
    fault = F.coalesce(
        c("head"), F.when(holds((c("kind") == "pdf") & ~c("native") & spoken(F.exists)), NATIVE_MIXED), c("sums.fault"),
        first_of(((whole(c("v"), "$.text_characters") == c("sums.characters")) & counted, INVALID), (c("claimed") == c("complete"), CONTRADICTED), (beyond, TOO_MUCH_TEXT)),
    )
    rows = rows.withColumns({"fault": fault, "features": F.when(c("kind") == "pdf", F.try_variant_get("v", "$.pdf_features", "variant"))})
    code, told = features(c("features"))
    late = F.coalesce(F.when((c("kind") == "image") & c("nonvisual").isNull(), INVALID), code, F.when(holds(c("complete") & (c("told.pages") != c("total"))), PAGES_CONTRADICTED))
    return rows.withColumn("told", told).select(doc, "kind", "total", "omitted", "complete", "reasons", "native", "nonvisual", c("sums.read").alias("read"), c("sums.native_read").alias("native_read"), "units", "told", "fault", late.alias("late"))


# Words of the rows.


def word_rows(v: Column) -> Column:
    """The list as an array of words whose fields are null where they aren't what a word has."""
    return F.transform(listed(v, "$"), lambda w: F.struct(string(w, "$.text").alias("text"), *[number(w, f"$.{side}").alias(side) for side in C.BOX], whole(w, "$.block").alias("block"), whole(w, "$.line").alias("line")))


def is_word(w: Column) -> Column:
    inside = reduce(and_, [w[side].between(0, 1) for side in C.BOX])
    places = w["block"].between(1, MAX_PLACE) & w["line"].between(1, MAX_PLACE)
    return holds(F.char_length(w["text"]).between(1, MAX_WORD) & ~w["text"].rlike(BLANK) & inside & (w["left"] < w["right"]) & (w["top"] < w["bottom"]) & places)


def plain(text: Column) -> Column:
    """Tokens with one blank between them, in normal form."""
    return C.composed(F.array_join(F.filter(F.split(text, BLANK), lambda x: x != ""), " "))


def is_torn(words: Column) -> Column:
    """Whether a line is taken up again after another one: it starts more often than there are lines."""
    place = F.transform(words, lambda w: F.struct(w["block"], w["line"]))
    none = F.struct(F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("bigint").alias("line"))
    start = F.struct(none.alias("last"), F.lit(0).alias("starts"))
    starts = F.aggregate(place, start, lambda s, p: F.struct(F.struct(p["block"].alias("block"), p["line"].alias("line")).alias("last"), (s["starts"] + F.when(s["last"]["block"].eqNullSafe(p["block"]) & s["last"]["line"].eqNullSafe(p["line"]), 0).otherwise(1)).alias("starts")), lambda s: s["starts"])
    return starts > F.size(F.array_distinct(place))


def checked_units(sound: DataFrame, doc: str) -> DataFrame:
    """A row for each unit of the accounts, with the words of both channels and the unit's own code."""
    u = sound.select(doc, "kind", "complete", "native", F.explode("units").alias("u")).select(doc, "kind", "complete", F.col("native").alias("asked"), "u.*")
    c = F.col
    pdf = c("kind") == "pdf"
    listing = lambda name: (shape(c(name)) == NONE) | shape(c(name)).startswith("ARRAY")
    u = u.withColumns({"lists": listing("ocr_words") & (~pdf | listing("native_words")), "unlisted": pdf & c("asked") & c("verified") & ((shape(c("ocr_words")) == NONE) | (shape(c("native_words")) == NONE))})
    empty = lambda a: F.coalesce(a, F.from_json(F.lit("[]"), "array<struct<text string, left double, top double, right double, bottom double, block bigint, line bigint>>"))
    u = u.withColumns({"ocr_words": empty(word_rows(c("ocr_words"))), "native_words": F.when(pdf, empty(word_rows(c("native_words")))).otherwise(empty(F.lit(None)))})
    spelled = lambda name: plain(F.array_join(F.transform(name, lambda w: w["text"]), " "))
    u = u.withColumns({"a": spelled("ocr_words"), "b": plain(F.coalesce("text", F.lit(""))), "x": spelled("native_words"), "y": plain(F.coalesce("native_text", F.lit("")))})
    letters = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda s, w: s + F.coalesce(F.char_length(w["text"]), F.lit(0)))
    u = u.withColumns({"n_words": (F.size("ocr_words") + F.size("native_words")).cast("long"), "n_chars": letters("ocr_words") + letters("native_words")})

    def channel(name: str, spelt: str, text: str) -> Column:
        told = first_of((F.size(name) <= MAX_WORDS, BAD_WORDS), (F.forall(name, is_word) & (letters(name) <= MAX_WORD_CHARS), BAD_WORDS), (c(spelt) == c(text), OTHER_TEXT), (~is_torn(c(name)), TORN_LINE))
        return F.when((F.size(name) > 0) | c("verified"), told)

    claim = c("verified").isNotNull() & c("why").isin(*GEOMETRY_REASONS) & (~c("has_geometry") | c("has_verified")) & (c("verified") == (c("why") == "verified"))
    sized = holds(c("width").between(1, MAX_PIXELS) & c("height").between(1, MAX_PIXELS) & (c("width") * c("height") <= MAX_PIXELS))
    done = (c("render") == "completed") & (c("ocr") == "completed") & ~c("truncated")
    processed = holds(F.when(pdf, done & (c("native") == "completed") & ~c("native_truncated")).otherwise(done))
    u = u.withColumn("processed", processed)
    fault = F.coalesce(
        first_of((claim, BAD_CLAIM), (sized | (c("no_width") & c("no_height") & ~c("verified")), BAD_SIZE), (~c("verified") | c("processed"), BAD_CHANNEL), (c("lists"), BAD_LIST), (~c("unlisted"), BAD_WORDS)),
        channel("native_words", "x", "y"), channel("ocr_words", "a", "b"),
    )
    eligible = holds(c("verified") & c("complete"))
    reason = F.when(c("verified") & ~c("complete"), C.INCOMPLETE).otherwise(c("why"))
    return u.withColumns({"fault": fault, "eligible": eligible, "reason": reason, "unit": c("ordinal").cast("int")}).drop("a", "b", "x", "y", "lists", "unlisted", "has_geometry", "has_verified", "ordinal", "no_width", "no_height")


@dataclass(frozen=True)
class Accounted:
    """documents: a row for each account. units and words: of accounts that aren't refused, as
    `channels.document_channels` takes them."""

    documents: DataFrame
    units: DataFrame
    words: DataFrame


def accounted(reports: DataFrame, doc: str = "doc", maximum: int = MAX_TEXT) -> Accounted:
    """Accounts (doc, kind: pdf or image, report) to documents, units and words. `doc` must be a key.

    documents: (doc, kind, status, reason, fault, text, truncated, examined, unit, total, omitted, complete, reasons, read,
    native_read, native, reconciled, suppressed, native_verified, nonvisual, annotations). A refused account (null, no
    JSON, contradicted, ...) is `failed` and has its code as `fault`, no text and no units. Text has a form feed between
    units and is cut at `maximum` characters; units of what is cut have no coordinates.
    """
    ship(reports.sparkSession)
    c, by = F.col, [doc, "unit"]
    limit = min(maximum, MAX_TEXT)
    told = durable(claims(reports, doc, limit))
    units = durable(checked_units(told.where("fault is null"), doc))
    geometry = units.groupBy(doc).agg(F.min_by("fault", F.when(c("fault").isNotNull(), c("unit"))).alias("bad"), F.sum("n_words").alias("n_words"), F.sum("n_chars").alias("n_chars"))
    geometry = geometry.select(doc, F.coalesce("bad", F.when((c("n_words") > MAX_WORDS) | (c("n_chars") > MAX_WORD_CHARS), TOO_MANY_WORDS)).alias("bad"))
    whole_told = durable(told.join(geometry, doc, "left").withColumn("fault", F.coalesce("fault", "bad", "late")).drop("bad", "late", "units"))
    good = units.drop("fault").join(whole_told.where("fault is null").select(doc), doc, "left_semi")

    word = lambda channel: good.where("verified").select(*by, "kind", F.lit(channel).alias("channel"), F.posexplode(f"{channel}_words").alias("ordinal", "w"))
    words = word("native").unionByName(word("ocr")).select(*by, "kind", "channel", "ordinal", "w.text", *[f"w.{side}" for side in C.BOX], c("w.block").cast("int").alias("block"), c("w.line").cast("int").alias("line"))
    words = durable(words)
    # Pages whose channels can be reconciled; a verified page without words is one as well.
    pages = C.page_texts(words.where("kind = 'pdf'").drop("kind"), by).select(*by, c("text").alias("joined"), c("suppressed").alias("gone"), "conflicts", F.lit(True).alias("met"))
    clean = lambda name: F.replace(F.coalesce(c(name), F.lit("")), F.lit(C.UNIT_GAP), F.lit("\n"))
    seen = good.join(pages.hint("merge"), by, "left").withColumn("planned", c("asked") & c("verified") & (c("met").isNull() | c("conflicts").isNotNull()))
    side_by_side = F.array_join(F.filter(F.array(clean("native_text"), clean("text")), lambda x: x != ""), C.PART_GAP)
    canonical = F.when(c("planned"), F.coalesce(clean("joined"), F.lit(""))).when(c("asked"), side_by_side).otherwise(clean("text"))
    seen = durable(seen.withColumns({"canonical": canonical, "agreed": c("planned") & c("processed") & (F.coalesce("conflicts", F.lit(0)) == 0)}))
    texts = seen.groupBy(doc).agg(
        F.array_join(F.transform(C.listed("unit", "canonical"), lambda x: x["canonical"]), C.UNIT_GAP).alias("text"), F.min("agreed").alias("agreed"),
        F.sum(F.when(c("planned"), F.coalesce("gone", F.lit(0))).otherwise(0)).cast("long").alias("suppressed"), F.min(~F.coalesce("native_text", F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")).alias("silent"),
    )

    ok, pdf = c("fault").isNull(), c("kind") == "pdf"
    d = whole_told.join(texts, doc, "left").withColumns({"text": F.when(ok, F.coalesce("text", F.lit(""))), "bare": holds(c("told.bare"))})
    d = d.withColumns({
        "reconciled": F.when(ok & pdf, c("complete") & c("native") & holds(c("agreed"))), "suppressed": F.when(ok & pdf, F.coalesce("suppressed", F.lit(0))),
        "native_verified": F.when(ok & pdf, holds(c("complete") & c("native") & c("bare") & (c("told.texts") == 0) & c("silent"))),
        "nonvisual": F.when(ok, F.when(pdf, ~c("bare")).otherwise(c("nonvisual"))), "annotations": F.when(ok, F.when(~pdf, "not_applicable").when(c("bare"), "none_present").otherwise("unverified")),
        "cut": F.coalesce(F.char_length("text") > maximum, F.lit(False)),
    })
    full = holds(F.when(pdf, c("complete") & c("reconciled") & c("native_verified") & c("bare")).otherwise(c("complete") & ~c("nonvisual")))
    status = F.when(~ok, "failed").when(full & ~c("cut"), "full").otherwise("partial")
    reason = F.when(~ok, REFUSED).when(c("cut"), CUT).when(~c("complete"), UNREAD).when(full, None).when(pdf, F.when(c("reconciled"), UNVERIFIED).otherwise(UNRESOLVED)).otherwise(UNINSPECTED)
    kept = lambda name: F.when(ok, c(name)).alias(name)
    documents = d.select(
        doc, "kind", status.alias("status"), reason.alias("reason"), "fault", F.substring("text", 1, maximum).alias("text"), c("cut").alias("truncated"), F.when(ok, c("read")).otherwise(0).alias("examined"), F.when(~ok, "bytes").when(pdf, "pages").otherwise("frames").alias("unit"),
        kept("total"), kept("omitted"), kept("complete"), kept("reasons"), kept("read"), kept("native_read"), kept("native"), "reconciled", "suppressed", "native_verified", "nonvisual", "annotations",
    )
    documents = durable(documents)
    out = seen.join(documents.select(doc, c("truncated").alias("cut")), doc)
    out = out.select(*by, "kind", (c("eligible") & ~c("cut")).alias("eligible"), F.when(c("cut"), C.TRUNCATED).otherwise(c("reason")).alias("reason"), "processed", "native_text", "text", "width", "height", c("render").alias("render_status"), c("ocr").alias("ocr_status"), c("native").alias("native_status"))
    return Accounted(documents, out, words.drop("kind"))


def coverage_view(report: Column) -> Column:
    """What is shown of a kept account: null if it is none, else (valid, total, completed, omitted, complete, uninspected,
    ancillary_unverified, units: (ordinal, render, ocr, truncated, characters)). All but `valid` are null where its rows
    don't agree with its totals. It may stand by itself or below `page_ocr`.
    """
    outer = F.when((F.char_length(report) > 0) & (F.char_length(report) <= MAX_VIEW), F.try_parse_json(report))
    below = bound(outer, lambda o: F.when(shape(o, "$.page_ocr").startswith("OBJECT"), F.try_variant_get(o, "$.page_ocr", "variant")).otherwise(o))
    return bound(below, lambda v: F.when(holds((string(v, "$.extractor") == READER) | (string(v, "$.protocol") == PROTOCOL)), bound(listed(v, "$.units"), lambda given: _view(v, given))))


def _view(v: Column, given: Column) -> Column:
    total, omitted = whole(v, "$.original_unit_count"), whole(v, "$.units_omitted")
    is_null = lambda path: shape(v, path) == "VOID"
    cut = lambda u: F.when(absent(u, "$.text_truncated"), flag(u, "$.truncated")).otherwise(flag(u, "$.text_truncated"))
    count = lambda u, path: bound(whole(u, path), lambda n: F.when(n >= 0, n))
    rows = F.transform(given, lambda u: F.struct(count(u, "$.ordinal").alias("ordinal"), string(u, "$.render_status").alias("render"), string(u, "$.ocr_status").alias("ocr"), cut(u).alias("truncated"), count(u, "$.text_characters").alias("characters")))
    n = F.size(given)
    sums = F.when(is_null("$.original_unit_count"), (n == 0) & is_null("$.units_omitted")).otherwise((total >= 1) & (n <= total) & (omitted == total - n))

    def stands(units: Column) -> Column:
        each = F.transform(units, lambda u, i: holds((u["ordinal"] == i + 1) & u["render"].isin(*RENDERED) & u["ocr"].isin(*READ) & u["truncated"].isNotNull() & ((u["render"] == "completed") | (u["ocr"] == "not_attempted"))))
        return holds((n <= MAX_UNITS) & F.forall(each, lambda x: x) & sums)

    def told(units: Column, valid: Column) -> Column:
        done = F.size(F.filter(units, lambda u: (u["render"] == "completed") & (u["ocr"] == "completed") & ~u["truncated"])).cast("long")
        shown = lambda x, name: F.when(valid, x).alias(name)
        return F.struct(
            valid.alias("valid"), shown(total, "total"), shown(done, "completed"), shown(omitted, "omitted"), shown(holds(flag(v, "$.page_accounting_complete") & (done == total)), "complete"),
            shown(~holds(~flag(v, "$.nonvisual_content_present")), "uninspected"), shown(holds(string(v, "$.embedded_annotation_coverage") == "unverified"), "ancillary_unverified"), shown(units, "units"),
        )

    return bound(rows, lambda units: bound(stands(units), lambda valid: told(units, valid)))
