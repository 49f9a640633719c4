"""Scanning the columns of a table: each column is an object with a status, counts, a fingerprint and findings.

A table is read once; its cells become rows (row, column, value), and everything else is grouped by column or searched
cell by cell. References to patients come from the same row and nowhere else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.recognizers import IDENTIFIERS, RULES, Recognizer
from ..functions.structured import render_udf
from ..functions.text import location, segments, structured_kind
from ..common import ship
from ..sources.options import Options, wide_row_limits
from .findings import Context, detect, evidence

#: A fixed value: what the segment that begins a text is called.
FIRST_SEGMENT = "segment:1/block:1/row:1"
REFERENCE = "struct<kind:string,value:string>"


def as_text(c: Column, kind: T.DataType) -> Column:
    """Cells as text: containers as JSON, everything else cast."""
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def sample(table: DataFrame, options: Options, order: list[str]) -> tuple[DataFrame, Column]:
    """Rows to look at, numbered from 1 in `_row`, and whether there are more.

    A sample is the first `table_sample_rows` by `order`, found by one row more than wanted: a bounded top-n, so only it
    is numbered. A full scan has all rows, numbered by their place in the input without a sort.
    """
    if options.full_scan:
        return table.withColumn("_row", F.monotonically_increasing_id() + 1), F.lit(False)
    n = options.table_sample_rows
    head = (table.orderBy(*[F.col(f"`{c}`") for c in order]) if order else table).limit(n + 1)
    numbered = head.withColumn("_row", F.row_number().over(Window.orderBy(*[F.col(f"`{c}`") for c in order] or [F.lit(0)])).cast("long"))
    return numbered.where(F.col("_row") <= n + 1), F.lit(True)


def cells(table: DataFrame, patients: set[str], limit: int) -> DataFrame:
    """(row, column, full, value, references, ambiguous): a row for each cell that isn't binary; nulls included."""
    text = {f.name: f for f in table.schema.fields if f.name != "_row" and not isinstance(f.dataType, T.BinaryType)}
    if not text:
        return table.sparkSession.createDataFrame([], f"row long, column string, full string, value string, references array<{REFERENCE}>, ambiguous boolean")
    own = [c for c in text if c in patients or _is_patient(c)]

    def reference(c: str) -> Column:
        v = as_text(F.col(f"`{c}`"), text[c].dataType)
        name = c.lower()
        kind = name.upper() if name in ("mrn", "uhid") else "ABHA" if name.startswith("abha") else "PATIENT_REFERENCE"
        plain = F.lit(not isinstance(text[c].dataType, (T.ArrayType, T.MapType, T.StructType))) & structured_kind(v).isNull()
        there = v.isNotNull() & (F.trim(v) != "")
        return F.struct(F.when(there & plain, F.struct(F.lit(kind).alias("kind"), v.alias("value"))).alias("r"), (there & ~plain).alias("unclear"))

    all_refs = F.array(*[reference(c) for c in own]) if own else F.array().cast(f"array<struct<r:{REFERENCE},unclear:boolean>>")
    refs = F.array_distinct(F.filter(F.transform(all_refs, lambda x: x["r"]), lambda r: r.isNotNull()))
    rows = table.select("_row", refs.alias("references"), F.exists(all_refs, lambda x: x["unclear"]).alias("unclear"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_text(F.col(f"`{c}`"), f.dataType).alias("full")) for c, f in text.items()])).alias("c"))
    return rows.select(F.col("_row").alias("row"), "c.column", "c.full", F.substring("c.full", 1, limit).alias("value"), "references", (F.col("unclear") | (F.size("references") > 1)).alias("ambiguous"))


def _is_patient(name: str) -> bool:
    return re.search(P.PATIENT_COLUMN, name) is not None


def fingerprints(values: DataFrame) -> DataFrame:
    """(column, fingerprint): SHA-256 over the column's cells in row order, each framed by its length; nulls are marked.

    The digest is sequential, so a column is one stream; its rows are sorted outside of Python and read batch by batch,
    so no column has to fit in memory.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[str, object] = {}
        for batch in batches:
            for column, value in zip(batch["column"], batch["full"], strict=True):
                state = states.setdefault(column, hashlib.sha256())
                if value is None:
                    state.update(b"null\0")  # type: ignore[attr-defined]
                else:
                    data = value.encode("utf-8", "replace")
                    state.update(len(data).to_bytes(8, "big"))  # type: ignore[attr-defined]
                    state.update(data)  # type: ignore[attr-defined]
        yield pd.DataFrame({"column": list(states), "fingerprint": [s.hexdigest() for s in states.values()]})  # type: ignore[attr-defined]

    return values.select("column", "row", "full").repartition("column").sortWithinPartitions("column", "row").mapInPandas(digest, "column string, fingerprint string")


def full_fingerprints(table: DataFrame, key: list[str]) -> DataFrame:
    """(column, fingerprint) of a whole table: SHA-256 over sums of the digests of its cells, each with its row's key.

    Sums don't depend on how the input is split or sorted, and are built up within each task, so no column passes
    through one. A value that moves to another key changes them; without a key only the multiset of values counts.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in key])) if key else F.lit("")
    digest = lambda f: F.sha2(F.concat(row, F.lit("="), F.coalesce(F.concat(F.lit("v"), as_text(F.col(f"`{f.name}`"), f.dataType)), F.lit("n"))), 256)
    text = [f for f in table.schema.fields if not isinstance(f.dataType, T.BinaryType)]
    if not text:
        return table.sparkSession.createDataFrame([], "column string, fingerprint string")
    each = table.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), digest(f).alias("digest")) for f in text])).alias("c")).select("c.*")
    lanes = [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return each.groupBy("column").agg(F.sha2(F.concat_ws(",", *lanes), 256).alias("fingerprint"))


def cell_texts(values: DataFrame) -> DataFrame:
    """Cells that hold something, with `id` and the text `t` to search: their column's name and value, or a record alone.

    `lead` is the length of the name before the value.
    """
    kinds = structured_kind(F.col("value"))
    prefix = F.concat(F.regexp_replace("column", r"(?U)\s+", " "), F.lit(": "))
    filled = values.where("value is not null and trim(value) <> ''")
    return filled.withColumns({"id": F.struct("column", "row"), "t": F.when(kinds.isNotNull(), F.col("value")).otherwise(F.concat(prefix, F.col("value"))), "lead": F.when(kinds.isNotNull(), 0).otherwise(F.char_length(prefix))})


def cell_findings(values: DataFrame, own: list[str], rules: tuple[Recognizer, ...] = RULES) -> DataFrame:
    """(column, row, entity_type, classification, confidence, match_count, reason) of cells, as `cells` gives them.

    `own`: columns that name a patient. A filled cell of one without an identifier is a reference by its column.
    """
    said = cell_texts(values)
    found = detect(said, "id", "t", Context(column="column", references="references", ambiguous="ambiguous"), rules).select("object.column", "object.row", "entity_type", "classification", "confidence", "match_count", "reason")
    if not own:
        return found
    named = said.where(F.col("column").isin(*own)).select("column", "row").join(found.where(F.col("entity_type").isin(*IDENTIFIERS)).select("column", "row").distinct(), ["column", "row"], "left_anti")
    return found.unionByName(named.select("column", "row", F.lit("PATIENT_REFERENCE").alias("entity_type"), F.lit(P.PERSONAL).alias("classification"), F.lit(0.85).alias("confidence"), F.lit(1).cast("long").alias("match_count"), F.lit(P.REASON_COLUMN).alias("reason")))


def cell_evidence(values: DataFrame, rules: tuple[Recognizer, ...] = RULES) -> DataFrame:
    """At most three examples for each column, type and reason, the first by row: (column, entity_type, reason, example, segment, value, excerpt, start, end).

    `values` as `cells` gives them. Places and excerpts are those within the cell: the column's name, which was put
    before it to be searched, is taken off again, and a span that reaches into it, or whose value isn't found at its
    place in the cell, is no example. Segments are `scan_row:<row>/<segment of the cell>`. Nulls and empty cells have none.
    """
    ship(values.sparkSession)
    said = cell_texts(values)
    seen = evidence(said, "id", "t", Context(column="column"), rules).withColumns({"column": F.col("object.column"), "row": F.col("object.row")})
    kind = structured_kind(F.col("value"))
    shown = F.coalesce(render_udf()(F.when(kind.isNotNull(), F.col("value")), kind)["text"], F.col("value"))
    own = said.select("column", "row", "lead", F.explode(segments(shown)).alias("s")).select("column", "row", "lead", "s.segment", F.col("s.text").alias("cell"))
    both = seen.join(own, ["column", "row", "segment"])
    # Only the first segment begins with the column's name.
    lead = F.when(F.col("segment") == FIRST_SEGMENT, F.col("lead")).otherwise(0)
    both = both.withColumns({"start": F.col("start") - lead, "end": F.col("end") - lead}).where("start >= 0")
    there = F.substring(F.col("cell"), F.col("start") + 1, F.least(F.col("end") - F.col("start"), F.lit(P.VALUE_CHARS)))
    both = both.where(there == F.col("value")).withColumn("excerpt", F.substring(F.col("cell"), F.greatest(F.lit(1), F.col("start") + 1 - P.EXCERPT_BEFORE), F.lit(P.EXCERPT_CHARS)))
    w = Window.partitionBy("column", "entity_type", "reason").orderBy("row", "segment", "start", "end")
    first = both.withColumn("example", F.row_number().over(w)).where(F.col("example") <= P.EXAMPLES)
    return first.select("column", "entity_type", "reason", "example", F.concat(F.lit("scan_row:"), "row", F.lit("/"), "segment").alias("segment"), "value", "excerpt", "start", "end")


def scan_table(table: DataFrame, name: str, options: Options = Options(), key: list[str] | None = None, patients: set[str] = frozenset(), rules: tuple[Recognizer, ...] = RULES, fingerprint: bool = True) -> tuple[DataFrame, DataFrame]:  # type: ignore[assignment]
    """Coverage (a row for each column) and findings (by column, type, class and reason).

    An empty table gives full columns without rows. Columns that hold bytes are not looked into. Column names may clash
    with nothing: cells are kept apart by their names.
    """
    ship(table.sparkSession)
    limit, _ = wide_row_limits(len(table.columns), options.cell_chars, options.batch_size)
    limit = options.cell_chars if options.full_scan else min(limit, options.cell_chars)
    taken, sampled = sample(table, options, key or [])
    n = options.table_sample_rows
    kept = taken if options.full_scan else taken.where(F.col("_row") <= n)
    # Cells of a bounded sample, or of a table that is read once.
    values = cells(kept, set(patients), limit)
    more = F.lit(False) if options.full_scan else taken.agg((F.count(F.lit(1)) > n).alias("more"))
    kinds = structured_kind(F.col("value"))
    checked = values.withColumn("kind", kinds).withColumn("why", render_udf(limit)(F.when(F.col("kind").isNotNull(), F.col("value")), F.col("kind"))["reason"])
    counts = checked.groupBy("column").agg(F.count(F.lit(1)).alias("examined"), F.count("full").alias("nonempty"), F.max(F.char_length("full") > limit).alias("cut"), F.max(F.col("why").isNotNull()).alias("unverified"))
    binary = [f.name for f in table.schema.fields if isinstance(f.dataType, T.BinaryType)]
    spark = table.sparkSession
    every = spark.createDataFrame([(c, c in binary, i) for i, c in enumerate(table.columns)], "column string, binary boolean, ordinal int")
    coverage = every.join(F.broadcast(counts), "column", "left")  # a row for each column
    coverage = coverage.withColumn("more", F.lit(False)) if options.full_scan else coverage.crossJoin(F.broadcast(more))  # one row
    status = F.when(F.col("binary"), "unsupported").when(F.coalesce("cut", F.lit(False)) | F.coalesce("unverified", F.lit(False)), "partial").when(F.col("more"), "sampled").otherwise("full")
    reason = F.when(F.col("binary"), "binary_column_not_inspected").when(F.coalesce("cut", F.lit(False)), "cell_text_limit_reached").when(F.coalesce("unverified", F.lit(False)), "structured_cell_boundaries_unverified").when(F.col("more"), "bounded_prefix_sample")
    coverage = coverage.select(location(F.lit(name), F.col("column")).alias("location"), "column", status.alias("status"), reason.alias("reason"), F.when(F.col("binary"), 0).otherwise(F.coalesce("examined", F.lit(0))).cast("long").alias("examined"), F.lit("rows").alias("unit"), F.coalesce("nonempty", F.lit(0)).cast("long").alias("nonempty"))
    if fingerprint:
        digests = full_fingerprints(table, key or []) if options.full_scan else fingerprints(values)
        coverage = coverage.join(F.broadcast(digests), "column", "left")  # a row for each column

    found = cell_findings(values, [c for c in table.columns if c in patients or _is_patient(c)], rules)
    findings = found.groupBy("column", "entity_type", "classification", "reason").agg(F.max("confidence").alias("confidence"), F.sum("match_count").alias("match_count"))
    findings = findings.select(location(F.lit(name), F.col("column")).alias("location"), "entity_type", "classification", "confidence", "match_count", "reason", F.lit("column").alias("segment"))
    return coverage, findings


def scan_entities(table: DataFrame, options: Options = Options(), partition: str | None = None, rules: tuple[Recognizer, ...] = RULES, keys: tuple[str, str] = ("PartitionKey", "RowKey")) -> tuple[DataFrame, DataFrame]:
    """Coverage and findings where each row of a key-value table is an object with its properties for columns.

    `partition` keeps the entities of one partition only. Entities are taken in key order up to the lesser of the
    options' rows and objects; a row `[cloud-coverage]` says how many there were and whether there are more. Findings
    are by entity, and their segments `property:<name>`. An entity's key is the SHA-256 of its two keys as JSON.
    """
    ship(table.sparkSession)
    n = min(options.table_sample_rows, options.max_files)
    rows = table if partition is None else table.where(F.col(f"`{keys[0]}`") == partition)
    taken, _ = sample(rows, replace(options, table_sample_rows=n, full_scan=False), list(keys))
    kept = taken.where(F.col("_row") <= n)
    entity = F.sha2(F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in keys])), 256)
    limit, _ = wide_row_limits(len(table.columns), options.cell_chars, options.batch_size)
    limit = min(limit, options.cell_chars)
    values = cells(kept, set(), limit)
    named = kept.select(F.col("_row").alias("row"), entity.alias("object"))  # n rows at most
    cut = values.groupBy("row").agg(F.max(F.coalesce(F.char_length("full") > limit, F.lit(False))).alias("cut"))
    objects = named.join(F.broadcast(cut), "row", "left").select(F.col("object").alias("location"), F.when(F.col("cut"), "partial").otherwise("full").alias("status"), F.when(F.col("cut"), "cell_text_limit_reached").alias("reason"), F.lit(1).cast("long").alias("examined"))
    more = F.count(F.lit(1)) > n
    whole = taken.agg(more.alias("more"), F.least(F.count(F.lit(1)), F.lit(n)).alias("examined")).select(F.lit("[cloud-coverage]").alias("location"), F.when(F.col("more"), "sampled").otherwise("full").alias("status"), F.when(F.col("more"), "bounded_prefix_sample").alias("reason"), F.col("examined").cast("long").alias("examined"))
    found = cell_findings(values, [c for c in table.columns if _is_patient(c)], rules).join(F.broadcast(named), "row")
    return objects.unionByName(whole), found.select("object", "entity_type", "classification", "confidence", "match_count", "reason", F.concat(F.lit("property:"), "column").alias("segment"))


def missing_tables(requested: DataFrame, discovered: DataFrame) -> DataFrame:
    """Requested tables that aren't there, as coverage rows."""
    gone = requested.select("table").distinct().join(discovered.select("table"), "table", "left_anti")
    return gone.select(location(F.col("table")).alias("location"), F.lit("inaccessible").alias("status"), F.lit("requested_table_not_discovered").alias("reason"))


def selected_tables(discovered: DataFrame, requested: DataFrame) -> DataFrame:
    return discovered.join(requested.select("table").distinct(), "table", "left_semi")


# The evidence that columns hold a patient's key.
DECLARED, CONFIGURED = "declared_foreign_key_to_patient_table_or_identifier", "hospital_configured_identifier_column"


def patient_columns(foreign_keys: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """(table, columns, evidence) of the tables with columns that hold a patient's key, both sorted and without repeats.

    `foreign_keys` has a row for each key: table, referred_table, referred_columns, constrained_columns; `configured` has
    table and columns, as named by whoever runs the database. Nulls name nothing; a table without evidence has no row.
    """
    to_patient = F.col("referred_table").rlike(P.PATIENT_TABLE) | F.exists("referred_columns", lambda c: F.coalesce(c.rlike(P.PATIENT_COLUMN), F.lit(False)))
    told = foreign_keys.where(to_patient).select("table", F.col("constrained_columns").alias("columns"), F.lit(DECLARED).alias("evidence"))
    if configured is not None:
        told = told.unionByName(configured.where(F.size("columns") > 0).select("table", "columns", F.lit(CONFIGURED).alias("evidence")))
    each = told.select("table", "evidence", F.explode_outer("columns").alias("column"))
    return each.groupBy("table").agg(F.array_sort(F.collect_set("column")).alias("columns"), F.array_sort(F.collect_set("evidence")).alias("evidence"))
