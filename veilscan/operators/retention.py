"""Retention: what has expired, removed in batches of the oldest; and preparing a restored catalogue."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import ship

# The policy's defaults, and how many scans one pass removes.
RETENTION_DAYS, AUDIT_DAYS, BATCH = 30, 365, 100


def is_expired(at: Column, now: Column, days: int = RETENTION_DAYS, approved: bool = True) -> Column:
    """The moment it is due counts; nothing expires without approval. A null time doesn't."""
    return F.lit(approved) & F.coalesce(at + F.make_dt_interval(F.lit(days)) <= now, F.lit(False))


def purge(scans: DataFrame, now: Column, days: int = RETENTION_DAYS, approved: bool = True, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """The oldest expired scans to remove now, and the scans that stay. A bounded batch: it is broadcast."""
    due = scans.where(is_expired(F.col("created_at"), now, days, approved)).orderBy("created_at", "scan_id").limit(batch)
    return due, scans.join(F.broadcast(due.select("scan_id")), "scan_id", "left_anti")


def backlog(scans: DataFrame, now: Column, days: int = RETENTION_DAYS, approved: bool = True, batch: int = BATCH) -> DataFrame:
    n = F.count_if(is_expired(F.col("created_at"), now, days, approved))
    return scans.agg(n.alias("expired"), (n > batch).alias("backlog"))


def without_content(children: DataFrame, gone: DataFrame) -> DataFrame:
    return children.join(F.broadcast(gone.select("scan_id")), "scan_id", "left_anti")


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now).join(users.where("active").select("username"), "username", "left_semi")


def stable_key(secret: bytes) -> object:
    """HMAC-SHA256 of a text, in hex, as a column function. The secret stays in the closure, not in any table."""

    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else hmac.new(secret, x.encode(), hashlib.sha256).hexdigest())

    digest.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(digest, T.StringType())


def verify_restored(scans: DataFrame, objects: DataFrame, secret: bytes) -> DataFrame:
    """(scan_id, objects, mismatched): objects whose keys don't follow from source and location."""
    ship(scans.sparkSession)
    expected = stable_key(secret)(F.concat_ws(":", "source_id", F.sha2("location", 256)))  # type: ignore[operator]
    each = objects.join(scans.select("scan_id", "source_id"), "scan_id").withColumn("ok", F.col("object_key") == expected)
    return each.groupBy("scan_id").agg(F.count(F.lit(1)).alias("objects"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("mismatched"))


def drained(scans: DataFrame) -> DataFrame:
    """A restored catalogue has no scan under way: those are interrupted."""
    return scans.withColumn("status", F.when(F.col("status").isin("queued", "running", "paused"), "interrupted").otherwise(F.col("status")))


def attempts_allowed(attempts: DataFrame, limit: int = 5, seconds: int = 900) -> DataFrame:
    """Sign-in attempts (key, at) with whether each is within the limit of its sliding window."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("key").orderBy(F.col("at").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return attempts.withColumn("allowed", F.count(F.lit(1)).over(w) <= limit)
