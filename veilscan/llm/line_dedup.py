"""Line deduplication: lines sorted by hash over ranges of tasks, first occurrences streamed, keep bitmaps returned.

Each line long enough to count becomes a row of (hash, document, position), without its text. The rows are dealt out by
ranges of hash, document and position together, so a line that a third of all documents hold fills many tasks instead
of one, and each task streams its sorted rows: the first document of a run of equal hashes keeps its lines, later ones
lose theirs. A run may have begun in a task before; each task therefore tells the hash and the first document of its
first and last run, two rows a task, and the lines of its first run are decided from those.

What comes back is a bitmap for each document, a bit for each line, packed and deflated; texts never move in between.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from .common import kept_columns, materialize, own, own_name, ship, table, tidy

#: Code points that a line needs, stripped, to be compared at all.
MIN_CHARS = 10
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Kinds of rows that a task gives: a line that goes, a line of its first run, the hash and first document of a run.
GOES, OPEN, HEAD = 0, 1, 2


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def packed(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes())


def unpacked(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def kept_lines(text: str | None, bitmap: bytes | None) -> str:
    """The lines of a text that its bitmap keeps; all of them without one."""
    if bitmap is None:
        return text or ""
    lines = (text or "").split("\n")
    return "\n".join([lines[i] for i in np.flatnonzero(unpacked(bitmap, len(lines)))])


@pandas_udf(StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([kept_lines(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)


@pandas_udf(StringType())
def kept_sha256(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(kept_lines(t, k).encode("utf-8", "surrogatepass")).hexdigest() for t, k in zip(text, keep, strict=True)], dtype=object)


@pandas_udf(BinaryType())
def keep_bitmap(n: pd.Series, gone: pd.Series) -> pd.Series:
    """The bitmap of a document of n lines without those at the places `gone`."""

    def one(n: int, places: np.ndarray) -> bytes:
        keep = np.ones(n, bool)
        keep[np.asarray(places, np.int64)] = False
        return packed(keep)

    return pd.Series([one(a, b) for a, b in zip(n, gone, strict=True)], dtype=object)


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where the values are the same; two nulls are."""
    same = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, doc, text_key, n_lines, pos) in order, to rows of the same with `kind`; see the constants."""
    last: tuple[int, int] | None = None
    first = None  # an array of the first document of the run that goes on
    runs = 0

    def head(like: pa.RecordBatch, doc: pa.Array) -> pa.RecordBatch:
        values = {"a": pa.array([last[0]]), "b": pa.array([last[1]]), "doc": doc}
        row = [values.get(f.name, pa.nulls(1)).cast(f.type) for f in like.schema]
        return pa.RecordBatch.from_arrays([*row, pa.array([HEAD], pa.int8())], [*like.schema.names, "kind"])

    like = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, doc = batch["a"].to_numpy(), batch["b"].to_numpy(), batch["doc"]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = last != (a[0], b[0])
        run = runs + np.cumsum(new)  # the task's first run is 1
        if like is None:
            like, last, first = batch.slice(0, 0), (int(a[0]), int(b[0])), doc.slice(0, 1)
            yield head(like, first)
        # Each row's first document of its run: the one carried over stands before those of the batch.
        places = np.maximum.accumulate(np.where(new, np.arange(1, len(a) + 1), 0))
        own_first = pa.concat_arrays([first, doc]).take(pa.array(places))
        told = (run == 1) | ~_equal(doc, own_first)
        yield batch.take(pa.array(np.flatnonzero(told))).append_column("kind", pa.array(np.where(run == 1, OPEN, GOES)[told], pa.int8()))
        last, first, runs = (int(a[-1]), int(b[-1])), own_first.slice(len(a) - 1), int(run[-1])
    if runs > 1:
        yield head(like, first)


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_key, n_dropped, keep) for each document that loses lines: doc is its key, text_key a hash of its text.

    A line's key is the line stripped and with A-Z in lower case. Keys of MIN_CHARS code points or more that at least two
    documents hold lose all their lines but those of the document with the smallest key; repeats within that one stay.
    Rows with the same key are one document. A null key is one document too, and greater than all others; null texts
    have one empty line. Texts may be of any length. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    whole = docs.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    each = whole.select("doc", F.xxhash64("t").alias("text_key"), lines_of(F.col("t")).alias("lines"))
    # `task` tells rows apart that repeat in all else, so that ranges can split those as well.
    each = each.select("doc", "text_key", F.size("lines").alias("n_lines"), F.spark_partition_id().alias("task"), F.posexplode("lines").alias("pos", "line")).withColumn("line", line_key(F.col("line")))
    hashed = each.where(F.char_length("line") >= MIN_CHARS).select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), "doc", "text_key", "n_lines", "pos", "task")
    hashed = materialize(hashed, "line-hashes")  # ranges are found in a sample: that pass reads hashes, not texts
    order = ["a", "b", F.col("doc").asc_nulls_last(), "pos", "task"]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order).drop("task")
    out = f"a long, b long, doc {kind}, text_key long, n_lines int, pos int, kind byte"
    told = materialize(ranged.mapInArrow(tidy(first_occurrences), out), "line-runs")
    # At most two rows for each task that sorted lines.
    heads = told.where(F.col("kind") == HEAD).groupBy("a", "b").agg(F.min("doc").alias("first"))
    opened = told.where(F.col("kind") == OPEN).join(F.broadcast(heads), ["a", "b"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    columns = ["doc", "text_key", "n_lines", "pos"]
    gone = told.where(F.col("kind") == GOES).select(*columns).unionByName(opened.select(*columns))
    places = gone.groupBy("doc", "text_key", "n_lines").agg(F.collect_set("pos").alias("gone"))
    return places.select("doc", "text_key", F.size("gone").cast("long").alias("n_dropped"), keep_bitmap("n_lines", "gone").alias("keep"))


def mark_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n_lines, n_dropped (long) and keep (the bitmap; null where every line stays) appended.

    `kept_text(text, keep)` gives what stays. See `keep_bitmaps` for nulls, repeats and empty tables. Columns of `docs`
    with the appended names are replaced, whatever their case; names that differ in case only are refused (ValueError).
    """
    kept = kept_columns(docs, "n_lines", "n_dropped", "keep")
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marks = keep_bitmaps(docs.select(key, text), key, text).select(F.col("doc").alias(own_name("doc")), F.col("text_key").alias(own_name("mark")), "n_dropped", "keep")
    left = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(plain).alias(own_name("text")), F.size(lines_of(plain)).cast("long").alias("n_lines"))
    joined = left.join(marks, (own("text") == own("mark")) & F.col(f"`{key}`").eqNullSafe(own("doc")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the digest of what stays, for every row of `documents`; see `mark_lines`."""
    marked = mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_lines", "n_dropped", kept_sha256("text", "keep").alias("kept_sha256"))
