"""Files as objects: a listing that gates by name and size before any content is read, then extraction."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..common import durable, ship
from ..functions.patterns import ARCHIVE_SUFFIXES, DOCUMENT_SUFFIXES, TEXT_SUFFIXES
from ..functions.structured import extract_udf
from ..functions.text import object_key
from .options import Options

MAX_DEPTH = 64
LISTED = "path string, kind string, length long, depth int"


class Entries(DataSource):
    """Entries of a local tree that Spark's own file source leaves out: links, special files, what can't be read.

    The root's folders are listed by one task each. Links are named and never followed.
    """

    @classmethod
    def name(cls) -> str:
        return "veilscan-entries"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return EntriesReader(self.options["path"])


class EntriesReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        tops = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)]
        return [InputPartition(None), *map(InputPartition, sorted(tops))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top, depth = (self.root, 0) if partition.value is None else (partition.value, 1)
        pending = [(top, depth)]
        while pending:
            folder, depth = pending.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                yield folder, "inaccessible", None, depth
                continue
            for e in entries:
                try:
                    info = e.stat(follow_symlinks=False)
                except OSError:
                    yield e.path, "inaccessible", None, depth
                    continue
                if stat.S_ISLNK(info.st_mode):
                    yield e.path, "symlink", None, depth
                elif stat.S_ISDIR(info.st_mode):
                    if depth + 1 > MAX_DEPTH:
                        yield e.path, "depth_limit", None, depth
                    elif partition.value is not None:
                        pending.append((e.path, depth + 1))
                elif stat.S_ISREG(info.st_mode):
                    yield e.path, "file", info.st_size, depth
                else:
                    yield e.path, "special", None, depth


def entries(spark: SparkSession, root: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(Entries)
    return spark.read.format("veilscan-entries").option("path", root).load()


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def gated(listed: DataFrame, options: Options) -> DataFrame:
    """A listing (path, kind, length) with suffix, status and reason; null status: to be read.

    Names and sizes decide, so contents of what is left out never move.
    """
    s = suffix(F.col("path"))
    archive, known = s.isin(*ARCHIVE_SUFFIXES), s.isin(*TEXT_SUFFIXES, *DOCUMENT_SUFFIXES)
    ladder = [
        (F.col("kind") == "inaccessible", "inaccessible", "path_not_readable"), (F.col("kind") == "symlink", "excluded", "symlink_excluded"), (F.col("kind") == "depth_limit", "excluded", "directory_depth_limit"),
        (F.col("kind") == "special", "excluded", "special_file_excluded"), (archive, "excluded", "archive_scanning_disabled"), (~known, "unsupported", "unsupported_file_format"), (F.col("length") > options.max_file_bytes, "excluded", "file_size_limit"),
    ]
    status = reason = F.lit(None).cast("string")
    for when, st, why in reversed(ladder):
        status, reason = F.when(when, st).otherwise(status), F.when(when, why).otherwise(reason)
    return listed.withColumns({"suffix": s, "status": status, "reason": reason})


def local_root(root: str) -> str | None:
    """The path of a tree that is mounted, or None for an address of a store."""
    return root.removeprefix("file://") if root.startswith("file:///") else root if "://" not in root else None


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, length) of a tree. Mounted trees also list links, special files and what can't be read; links are
    never followed, and what lies behind them is no part of the tree."""
    if (mounted := local_root(root)) is not None:
        return entries(spark, mounted).select("path", "kind", "length")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.lit("file").alias("kind"), "length")


def open_below(root: str, path: str) -> int:
    """A descriptor of a file below a root. No part of the way may be a link: each is opened from the one before it."""
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    *folders, name = os.path.relpath(path, root).split(os.sep)
    try:
        for part in folders:
            inner = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
            os.close(at)
            at = inner
        return os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=at)
    finally:
        os.close(at)


def mounted_contents(wanted: DataFrame, root: str, most: int) -> DataFrame:
    """(path, listed, length, changed, content) of the listed files (wanted, listed) of a mounted tree, and of no others.

    A file is looked at before and after it is read; another size, time or file in between counts as changed. What is a
    link or no plain file by then, or can't be opened, is left out. One file at a time is in a worker.
    """
    held = os.path.realpath(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, listed in batch.itertuples(index=False, name=None):
                try:
                    fd = open_below(held, os.path.join(held, os.path.relpath(path, root)))
                except OSError:
                    continue
                with open(fd, "rb") as f:
                    before = os.fstat(f.fileno())
                    if not stat.S_ISREG(before.st_mode):
                        continue
                    content = f.read(most + 1)
                    after = os.fstat(f.fileno())
                same = (before.st_size, before.st_mtime_ns, before.st_ino) == (after.st_size, after.st_mtime_ns, after.st_ino) and len(content) == after.st_size == listed
                yield pd.DataFrame({"path": [path], "listed": [listed], "length": [before.st_size], "changed": [not same], "content": [content]})

    spread = wanted.repartition("wanted").select("wanted", "listed")
    return spread.mapInPandas(read, "path string, listed long, length long, changed boolean, content binary")


def scan_files(spark: SparkSession, root: str, options: Options = Options()) -> DataFrame:
    """Objects of a tree on any file system: (object_key, location, status, reason, unit, examined, fingerprint, text,
    linkage_verified). In mounted trees, those files only are opened that are listed and that the gates let through, and no
    link on the way to them. Stores have no links; their reader opens all files of known suffixes and sizes.

    The first `max_files` entries by path are objects; if there are more, a row `[coverage]` says so. A file that has
    changed since it was listed, or while it was read, is partial, and one that is gone by then is inaccessible.
    """
    ship(spark)
    names = listing(spark, root)
    taken = names.orderBy("path").limit(options.max_files)  # a bounded top-n of names
    listed = durable(gated(taken.withColumn("path", plain_path(F.col("path"))), options))
    more = names.limit(options.max_files + 1).groupBy().agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > options.max_files)
    none = [F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("linkage_verified")]
    cap = more.select(F.lit("[coverage]").alias("path"), F.lit("partial").alias("status"), F.lit("file_limit_reached").alias("reason"), F.lit("bytes").alias("unit"), F.lit(options.max_files).cast("long").alias("examined"), *none)
    out = listed.where("status is not null").select("path", "status", "reason", F.lit("bytes").alias("unit"), F.lit(0).cast("long").alias("examined"), *none)
    wanted = listed.where("status is null").select(F.col("path").alias("wanted"), F.col("length").alias("listed"))  # max_files rows at most
    if (mounted := local_root(root)) is not None:
        found = mounted_contents(wanted, mounted, options.max_file_bytes)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        contents = files.where((F.col("length") <= options.max_file_bytes) & suffix(F.col("path")).isin(*TEXT_SUFFIXES, *DOCUMENT_SUFFIXES)).withColumn("path", plain_path(F.col("path")))
        changed = (F.octet_length("content") != F.col("length")) | (F.col("length") != F.col("listed"))
        found = contents.join(F.broadcast(wanted), F.col("path") == F.col("wanted")).withColumn("changed", changed)
    read = found.select("path", "changed", "content", extract_udf(options.max_text_chars)(F.col("content"), suffix(F.col("path"))).alias("x"))
    read = durable(read.select("path", F.when(F.col("changed"), "partial").otherwise(F.col("x.status")).alias("status"), F.when(F.col("changed"), "file_changed_during_scan").otherwise(F.col("x.reason")).alias("reason"), "x.unit", "x.examined", F.sha2("content", 256).alias("fingerprint"), "x.text", "x.linkage_verified"))
    gone = wanted.join(read.select(F.col("path").alias("wanted")), "wanted", "left_anti").select(F.col("wanted").alias("path"), F.lit("inaccessible").alias("status"), F.lit("path_not_readable").alias("reason"), F.lit("bytes").alias("unit"), F.lit(0).cast("long").alias("examined"), *none)
    every = out.unionByName(read).unionByName(gone).unionByName(cap)
    return every.withColumn("location", F.col("path")).withColumn("object_key", object_key(F.col("path"))).drop("path")


def cloud_gate(size: Column, path: Column, etag: Column, options: Options) -> tuple[Column, Column]:
    """Status and reason before an object of a store is read; nulls: to be read."""
    s = suffix(path)
    ladder = [
        (s.isin(*ARCHIVE_SUFFIXES), "excluded", "archive_scanning_disabled"), (~s.isin(*TEXT_SUFFIXES, *DOCUMENT_SUFFIXES), "unsupported", "unsupported_file_format"), (size.isNull(), "partial", "object_size_unavailable"),
        (size > options.max_file_bytes, "excluded", "file_size_limit"), (etag.isNull(), "partial", "object_version_unavailable"),
    ]
    status = reason = F.lit(None).cast("string")
    for when, st, why in reversed(ladder):
        status, reason = F.when(when, st).otherwise(status), F.when(when, why).otherwise(reason)
    return status, reason


def error_reason(code: Column) -> Column:
    """A fixed reason for a store's error code; texts of errors never pass."""
    return F.when(code.isin("PreconditionFailed", "412", "ConditionNotMet"), "object_changed_during_scan").when(code.isin("Timeout", "RequestTimeout"), "object_download_time_limit").otherwise("cloud_object_unavailable")
