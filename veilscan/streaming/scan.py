"""Scanning what arrives: each micro-batch of files or rows is a scan of its own, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.findings import detect


def scan_stream(texts: DataFrame, key: str, text: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Findings of a stream of texts. A batch that is delivered again replaces its own folder and nothing else."""

    def write(batch: DataFrame, n: int) -> None:
        detect(batch, key, text).write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def coverage_stream(objects: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Objects by status in windows of time, as they come (ts, status); what is later than `late` is left out."""
    return objects.withWatermark("ts", late).groupBy(F.window("ts", every), "status").agg(F.count(F.lit(1)).alias("n"))
