"""Pages of a PDF from two readers, side by side: markup with an element for each page, and the file's own text by page.

Pages meet by ordinal, from both sides at once: a page that one reader lacks is a row as well. Pages that equal but for
white space and normal form are said once; text outside of all pages, and every page that differs, is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import durable, ship
from ..functions.structured import page_sheets_udf
from .accounts import CUT, UNVERIFIED, plain
from .channels import UNIT_GAP, listed

# How two pages of one ordinal compare, and the reason of documents that two readers disagree on.
EQUAL, DIFFERS, MOVED, MISSING, SURPLUS = "equal", "differs", "moved", "missing", "surplus"
BOTH_UNVERIFIED = "pdf_native_ocr_and_nonpage_coverage_unverified"

#: Anything but blanks.
SOME = r"(?U)[^\s\x1c-\x1f]"


def read_sheets(markup: DataFrame, doc: str) -> DataFrame:
    """(doc, pages, outside, sound, text) of (doc, markup); null counts as empty."""
    ship(markup.sparkSession)
    return durable(markup.select(doc, page_sheets_udf()("markup").alias("r")).select(doc, "r.*"))


def sheet_pairs(sheets: DataFrame, native: DataFrame, doc: str) -> DataFrame:
    """(doc, ordinal, state, text) for each ordinal of a document that either side has.

    sheets: as `read_sheets` gives them. native: (doc, unit, native_text). States: equal; moved (it equals the file's page
    of another ordinal); differs; missing (no element for the file's page; text is null); surplus (no page in the file).
    A document's pages come to one task, which bounds them by what a reader gives of one file.
    """
    told = sheets.select(doc, F.posexplode("pages").alias("ordinal", "text")).select(doc, (F.col("ordinal") + 1).alias("ordinal"), "text", F.lit(True).alias("marked"))
    file = native.select(doc, F.col("unit").alias("ordinal"), F.coalesce("native_text", F.lit("")).alias("text"), F.lit(False).alias("marked"))
    both = told.unionByName(file).withColumn("plain", plain(F.col("text"))).repartition(doc)
    both = both.withColumn("known", F.max(~F.col("marked")).over(Window.partitionBy(doc, "plain")))
    of = lambda marked, c: F.max(F.when(F.col("marked") == marked, F.col(c)))
    rows = both.groupBy(doc, "ordinal").agg(of(True, "text").alias("text"), of(True, "plain").alias("a"), of(False, "plain").alias("b"), of(True, "known").alias("known"))
    state = F.when(F.col("a").isNull(), MISSING).when(F.col("b").isNull(), SURPLUS).when(F.col("a") == F.col("b"), EQUAL).when(F.col("known"), MOVED).otherwise(DIFFERS)
    return rows.select(doc, "ordinal", state.alias("state"), "text")


def supplements(markup: DataFrame, native: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, text, mapped, suppressed, unmatched, outside) of (doc, markup) and (doc, unit, native_text).

    text: pages that differ from the file's page of their ordinal, then what stands outside of all pages. Where the pages
    can't be told apart or are of another number than the file's, `mapped` is false, `text` is all text there is, and
    unmatched is null.
    """
    sheets = read_sheets(markup, doc)
    pairs = sheet_pairs(sheets, native.join(sheets.select(doc), doc, "left_semi"), doc)
    kept = F.col("state").isin(DIFFERS, MOVED)
    sides = pairs.groupBy(doc).agg(
        F.count_if(F.col("state").isin(MISSING, SURPLUS)).alias("odd"), F.count_if(F.col("state") == EQUAL).alias("equal"), F.count_if(kept).alias("unmatched"),
        F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("ordinal", "text")))), lambda x: x["text"]).alias("parts"),
    )
    d = sheets.join(sides, doc, "left")
    mapped = F.coalesce(F.col("sound") & (F.size("pages") > 0) & (F.col("odd") == 0), F.lit(False))
    outside = F.col("outside").rlike(SOME)
    parts = F.concat("parts", F.when(outside, F.array("outside")).otherwise(F.array().cast("array<string>")))
    return d.select(
        doc, F.when(mapped, F.array_join(parts, UNIT_GAP)).otherwise(F.col("text")).alias("text"), mapped.alias("mapped"), F.when(mapped, F.col("equal")).otherwise(0).alias("suppressed"),
        F.when(mapped, F.col("unmatched")).alias("unmatched"), outside.alias("outside"),
    )


def merged_documents(documents: DataFrame, supplement: DataFrame, doc: str = "doc", maximum: int = 1_000_000) -> DataFrame:
    """(doc, status, reason, text, reconciled): accounts of PDFs (`accounts.accounted`) with what the second reader adds.

    An account that is full stands for itself. Nothing else can be more than partial; if there is neither an account nor a
    supplement (no row, or null text) it has failed. Channels count as reconciled only if the second reader adds nothing.
    """
    c = F.col
    d = documents.select(doc, "status", "reason", c("text").alias("said"), "complete", c("reconciled").alias("agreed")).join(supplement.select(doc, "text", "mapped", "unmatched"), doc, "left")
    full = c("status") == "full"
    reconciled = F.coalesce(c("agreed") & c("mapped") & (c("unmatched") == 0) & ~c("text").rlike(SOME), F.lit(False))
    pieces = F.filter(F.array("said", "text"), lambda x: x != "")
    d = d.withColumns({"reconciled": F.when(full, c("agreed")).otherwise(reconciled), "joined": F.when(full, c("said")).otherwise(F.array_join(pieces, UNIT_GAP))})
    cut = F.char_length("joined") > maximum
    status = F.when(cut, "partial").when(full, "full").when((c("status") == "failed") & c("text").isNull(), "failed").otherwise("partial")
    reason = F.when(cut, CUT).when(full | ~F.coalesce("complete", F.lit(False)), c("reason")).when(c("reconciled"), UNVERIFIED).otherwise(BOTH_UNVERIFIED)
    return d.select(doc, status.alias("status"), reason.alias("reason"), F.substring("joined", 1, maximum).alias("text"), "reconciled")
