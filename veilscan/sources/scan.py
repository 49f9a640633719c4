"""Starting a scan: options, gates, the reader of the source's kind, and fixed reasons instead of errors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import durable
from ..operators.columns import scan_table
from ..operators.findings import Context, detect
from .files import scan_files
from .inventory import ABSENT, FAILED
from .options import InvalidOptions, Options, gate, normalized_config
from .tables import jdbc_table, parquet_table

COVERAGE = "location string, status string, reason string, examined long, unit string"
FINDINGS = "location string, entity_type string, classification string, confidence double, match_count long, reason string, segment string"
Reader = Callable[[SparkSession, dict[str, Any], Options], tuple[DataFrame, DataFrame]]


def one_object(spark: SparkSession, location: str, status: str, reason: str, unit: str = "bytes") -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([(location, status, reason, 0, unit)], COVERAGE), spark.createDataFrame([], FINDINGS)


def read_tree(spark: SparkSession, config: dict[str, Any], options: Options) -> tuple[DataFrame, DataFrame]:
    objects = scan_files(spark, config["root"], options)
    texts = objects.where("text is not null").withColumn("unverified", ~F.col("linkage_verified"))
    found = detect(texts, "location", "text", Context(unverified="unverified")).withColumnRenamed("object", "location")
    return objects.select("location", "status", "reason", "examined", "unit", "object_key", "fingerprint"), found


def one_table(spark: SparkSession, config: dict[str, Any], options: Options, name: str) -> tuple[DataFrame, DataFrame]:
    """A table's scan, carried out; a table that isn't there or can't be read is a row of its own."""
    try:
        table = parquet_table(spark, config["path"], name) if "path" in config else jdbc_table(spark, config["kind"], config, config["queries"][name], options)
        c, f = scan_table(table, name, options, config.get("keys", {}).get(name), set(config.get("patient_columns", {}).get(name, ())))
        return durable(c), durable(f)
    except AnalysisException as e:
        absent = e.getCondition() == "PATH_NOT_FOUND"
        return one_object(spark, name, *(("inaccessible", ABSENT) if absent else ("failed", FAILED)), unit="rows")
    except (PySparkException, Py4JJavaError):
        return one_object(spark, name, "failed", FAILED, unit="rows")


def read_tables(spark: SparkSession, config: dict[str, Any], options: Options) -> tuple[DataFrame, DataFrame]:
    """All tables, each by itself: what one of them fails with stops no other."""
    parts = [one_table(spark, config, options, name) for name in config["tables"]] or [(spark.createDataFrame([], COVERAGE), spark.createDataFrame([], FINDINGS))]
    both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return reduce(both, [c for c, _ in parts]), reduce(both, [f for _, f in parts])


READERS: dict[str, Reader] = {"filesystem": read_tree, "smb": read_tree, "s3": read_tree, "azure_blob": read_tree, "sqlite": read_tables, "postgresql": read_tables, "mysql": read_tables, "mssql": read_tables, "azure_table": read_tables}


def scan(spark: SparkSession, kind: str, config: dict[str, Any], options: dict[str, Any] | None = None, approved: bool = False) -> tuple[DataFrame, DataFrame]:
    """Coverage and findings of a source. What can't be scanned is a row with a reason, never an error's text.

    Stores and shares are read where they are mounted or by their Hadoop addresses: `root`.
    """
    try:
        chosen = Options.of(options)
    except InvalidOptions:
        return one_object(spark, kind, "failed", "invalid_scan_options")
    if stopped := gate(kind, chosen, approved, config.get("tables")):
        return one_object(spark, kind, *stopped)
    try:
        ready = config if "root" in config and kind != "filesystem" else normalized_config(kind, config)
        return READERS[kind](spark, ready | {"kind": kind}, chosen)
    except (InvalidOptions, KeyError, PySparkException):
        return one_object(spark, kind, "failed", "source_scan_failed")
