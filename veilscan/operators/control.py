"""States of scans, what may be asked of them, what the catalogue lets go of, and the trail of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retention import AUDIT_DAYS, BATCH, RETENTION_DAYS, is_expired

# States of a scan under way, and the seconds within which a heartbeat is fresh.
ACTIVE, FRESH_SECONDS = ("queued", "running", "paused"), 30
#: The greatest count that every reader of an export can hold exactly.
LARGEST_COUNT = 2**53 - 1
CHANGES = ("new", "changed", "no_longer_observed", "unchanged")


def acted(scans: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Scans (scan_id, status, heartbeat_at, ...) after the earliest request of each: (scan_id, action, at).

    `action` is what was asked and `accepted` whether the state allows it; both are null for scans without a request.
    Later requests wait for the next pass. A paused scan with a fresh heartbeat runs on, others that resume are queued
    anew, without a heartbeat. Requests for unknown scans have no row.
    """
    first = requests.groupBy("scan_id").agg(F.min_by("action", F.struct("at", "action")).alias("action"))
    state, action = F.col("status"), F.col("action")
    fresh = F.coalesce(F.col("heartbeat_at") > now - F.make_dt_interval(secs=F.lit(FRESH_SECONDS)), F.lit(False))
    then = (
        F.when((action == "pause") & state.isin("queued", "running"), "paused")
        .when((action == "resume") & (state == "paused") & fresh, "running")
        .when((action == "resume") & state.isin("paused", "interrupted"), "queued")
        .when((action == "cancel") & state.isin(*ACTIVE, "interrupted"), "cancelled")
    )
    out = scans.join(first, "scan_id", "left").withColumn("_then", then)
    requeued = F.col("_then") == "queued"
    out = out.withColumn("accepted", F.when(action.isNotNull(), F.col("_then").isNotNull()))
    return out.withColumns({"heartbeat_at": F.when(~F.coalesce(requeued, F.lit(False)), F.col("heartbeat_at")), "status": F.coalesce("_then", "status")}).drop("_then")


def refusals(sources: DataFrame, scans: DataFrame) -> DataFrame:
    """Sources with `refusal`, why a scan of them can't be queued now: disabled, or one is under way. Null: it can."""
    busy = scans.where(F.col("status").isin(*ACTIVE)).select("source_id").distinct().withColumn("_busy", F.lit(True))
    why = F.when(~F.coalesce("enabled", F.lit(False)), "source_disabled").when(F.col("_busy"), "active_scan")
    return sources.join(busy, "source_id", "left").withColumn("refusal", why).drop("_busy")


def expired_counts(scans: DataFrame, sessions: DataFrame, audit: DataFrame, now: Column, days: int = RETENTION_DAYS, audit_days: int = AUDIT_DAYS) -> DataFrame:
    """One row: expired scans, sessions and audit entries. The moment something is due counts."""
    counts = scans.agg(F.count_if(is_expired(F.col("created_at"), now, days)).alias("scans"))
    counts = counts.join(F.broadcast(sessions.agg(F.count_if(F.col("expires_at") <= now).alias("sessions"))))  # one row
    return counts.join(F.broadcast(audit.agg(F.count_if(is_expired(F.col("at"), now, audit_days)).alias("audit"))))  # one row


def let_go(rows: DataFrame, key: str, due: Column, order: str, batch: int = BATCH) -> DataFrame:
    """The rows that stay after one pass: of those due, the `batch` first by `order` and key go. Keys are unique."""
    gone = rows.where(due).orderBy(order, key).limit(batch).select(key)
    return rows.join(F.broadcast(gone), key, "left_anti")  # a batch at most


def sessions_left(sessions: DataFrame, now: Column, batch: int = BATCH) -> DataFrame:
    return let_go(sessions, "session_id", F.col("expires_at") <= now, "expires_at", batch)


def audit_left(audit: DataFrame, now: Column, days: int = AUDIT_DAYS, batch: int = BATCH) -> DataFrame:
    return let_go(audit, "audit_id", is_expired(F.col("at"), now, days), "at", batch)


def trail(events: DataFrame, actor: Column, action: Column, at: Column, *detail: str) -> DataFrame:
    """(at, actor, action, detail): rows to append to the audit; detail is JSON of the columns named, without nulls."""
    return events.select(at.alias("at"), actor.alias("actor"), action.alias("action"), F.to_json(F.struct(*detail)).alias("detail"))


def candidates(scans: DataFrame, baseline: str | int) -> DataFrame:
    """Scans that the baseline can be compared with: all others of its source; where it isn't known, all scans."""
    base = scans.where(F.col("scan_id") == baseline).agg(F.max("source_id").alias("_source"))  # one row
    return scans.where(F.col("scan_id") != baseline).join(F.broadcast(base)).where("_source IS NULL OR source_id = _source").drop("_source")


def shown_deltas(changes: DataFrame, deltas: DataFrame, policy_changed: bool = False) -> DataFrame:
    """Objects (object_key, change, comparable) with how many of their findings changed and how many did not.

    `reason` says why no conclusion is drawn; the numbers are null then. A count that is null, negative or too large to
    be read exactly, or an unknown change, spoils its object.
    """
    sound = lambda c: F.coalesce(F.col(c).between(0, LARGEST_COUNT), F.lit(False))
    good = sound("before_count") & sound("after_count") & F.coalesce(F.col("change").isin(*CHANGES), F.lit(False))
    per = deltas.groupBy("object_key").agg(F.count_if(F.col("change") != "unchanged").alias("_changed"), F.count_if(F.col("change") == "unchanged").alias("_same"), F.max(~good).alias("_bad"))
    why = (
        F.when(F.lit(policy_changed), "detector_or_policy_changed").when(F.col("change").isin("coverage_lost", "not_comparable"), "coverage_insufficient")
        .when(~F.coalesce("comparable", F.lit(False)), "findings_unavailable").when(F.coalesce("_bad", F.lit(False)), "counts_unavailable")
    )
    out = changes.join(per, "object_key", "left").withColumn("reason", why)
    count = lambda c: F.when(F.col("reason").isNull(), F.coalesce(c, F.lit(0))).cast("long")
    return out.select("object_key", "change", "reason", count("_changed").alias("changed"), count("_same").alias("unchanged"))
