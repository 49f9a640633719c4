"""Sending this package to the executors' Python, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that goes to a Python worker: whole texts in batches of Spark's 10,000 take its memory several times.
ROWS_AT_ONCE = 1_000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each session; they need no installation of it. Where Spark's default
    holds, Python gets ROWS_AT_ONCE rows at a time."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    context = spark.sparkContext
    if getattr(context, "_veilscan_core", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="veilscan-")) / "veilscan.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._veilscan_core = True


def durable(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the checkpoint folder that driver and executors share.

    Its joins sort and merge: Spark guesses the size of what a plan like this gives from the files it began with, which
    explodes and joins have long outgrown, and would gather whole tables in the driver to broadcast them.

    A local session without one gets a temporary folder; on a cluster that would be the driver's alone, so a RuntimeError
    is raised there.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="veilscan-"))
    return df.checkpoint().hint("merge")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt by `by` to as many partitions as the session shuffles to, whatever the rows' size.

    For rows that cost Python far more time than their bytes tell: Spark would merge partitions of few bytes into one, or
    leave a table of one file to a single task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
