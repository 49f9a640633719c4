"""Reading tables, scratch tables and small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import ship as ship_package

__all__ = ["kept_columns", "materialize", "own", "own_name", "released", "scratch_dir", "ship", "table", "tidy"]

#: Columns that operators add for themselves begin with this; tables with such columns are refused.
OWN = "__veilscan_"
#: Rows of a batch that goes to a Python worker. Whole texts in batches of Spark's 10,000 take a worker's memory several
#: times over: as Arrow buffers in the JVM and in Python, and as strings.
ROWS_AT_ONCE = 1_000
#: Bytes after which a batch ends however few rows it has: 1,000 chunks of a text are over 20 MB, and Spark allows 64.
BYTES_AT_ONCE = 4 << 20


def ship(spark: SparkSession) -> None:
    """The package for the executors, and batches of ROWS_AT_ONCE rows and BYTES_AT_ONCE bytes, and no more than a row
    over, for this session where Spark's defaults hold."""
    ship_package(spark)
    for setting, default, held in (("maxRecordsPerBatch", "10000", ROWS_AT_ONCE), ("maxBytesPerBatch", "67108864b", BYTES_AT_ONCE)):
        if spark.conf.get(name := f"spark.sql.execution.arrow.{setting}") == default:
            spark.conf.set(name, held)


def own_name(name: str) -> str:
    return OWN + name


def own(name: str) -> Column:
    return F.col(OWN + name)


def kept_columns(df: DataFrame, *outputs: str) -> list[str]:
    """The columns of `df` that an operator hands on: all but those that it gives anew, whatever their case.

    Raises ValueError for names that begin like the operators' own and for names that differ in case only.
    """
    seen: set[str] = set()
    for c in df.columns:
        if c.lower().startswith(OWN) or c.lower() in seen:
            raise ValueError(f"column {c!r} is reserved or given twice")
        seen.add(c.lower())
    new = {c.lower() for c in outputs}
    return [c for c in df.columns if c.lower() not in new]


def released(*caches: dict) -> None:
    """Clear caches and give freed memory back to the system, so that a worker that waits for its next task is small."""
    for cache in caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function, after which its worker gives memory back."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            released()

    run.__annotations__ = getattr(f, "__annotations__", {})
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, whatever file system that is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where it is unset, as in local tests, a temporary folder is used and set for the session. On a cluster that would be
    a folder of the driver alone, so a RuntimeError is raised there.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = context.getCheckpointDir()
        if current is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="veilscan-"))
            current = context.getCheckpointDir()
        configured = current
    return configured.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a Parquet table in the shared folder and read it back.

    It cuts the lineage and survives the loss of executors: what follows reads files and never recomputes what
    was gathered. Columns keep their names and types.
    """
    path = f"{scratch_dir(df.sparkSession)}/veilscan-scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
