"""Comparing two scans: changes of objects and deltas of findings. A gap in coverage never counts as a removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import INSUFFICIENT

IDENTITY = ("entity_type", "classification", "reason", "segment")


@dataclass(frozen=True)
class Scans:
    """What is known of both scans besides their rows."""

    same_source: bool = True
    both_completed: bool = True
    detector_changed: bool = False
    options_changed: bool = False
    provenance_unknown: bool = False

    def check(self) -> None:
        if not (self.same_source and self.both_completed):
            raise ValueError("only completed scans of one source can be compared")


def provenance_known(version: Column) -> Column:
    return version.rlike("/runtime-(bundle|local)-[a-f0-9]{64}$")


def multisets(findings: DataFrame) -> DataFrame:
    """Counts by object and identity; nulls in an identity are values like others."""
    return findings.groupBy("object_key", *IDENTITY).agg(F.sum("match_count").alias("count"))


def object_changes(old: DataFrame, new: DataFrame, old_findings: DataFrame, new_findings: DataFrame, scans: Scans = Scans()) -> DataFrame:
    """(object_key, change) of the objects of either scan (object_key, status, examined, fingerprint).

    The first that holds: gone or less seen; not comparable; new; no longer found; changed; unchanged. Two outer joins by
    object, on keys that both sides share; each multiset is folded to one row for each object before it is joined.
    """
    scans.check()

    def folded(f: DataFrame) -> DataFrame:
        # Sums of hashes don't depend on order, so equal multisets give equal values.
        h = F.xxhash64(*[F.col(c) for c in IDENTITY], "count")
        return multisets(f).groupBy("object_key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("low"), F.sum(F.pmod(F.shiftrightunsigned(h, 24), F.lit(1 << 40))).alias("high"))

    side = lambda o, f, p: o.select("object_key", *[F.col(c).alias(f"{p}_{c}") for c in ("status", "examined", "fingerprint")], F.lit(True).alias(f"{p}_there")).join(folded(f).select("object_key", *[F.col(c).alias(f"{p}_{c}") for c in ("kinds", "low", "high")]), "object_key", "left")
    both = side(old, old_findings, "a").join(side(new, new_findings, "b"), "object_key", "full_outer")
    c = F.col
    there = lambda p: F.coalesce(c(f"{p}_there"), F.lit(False))
    weak = lambda p: F.coalesce(c(f"{p}_status").isin(*INSUFFICIENT), F.lit(False))
    full = lambda p: F.coalesce(c(f"{p}_status") == "full", F.lit(False))
    some = lambda p: F.coalesce(c(f"{p}_kinds"), F.lit(0)) > 0
    same = F.coalesce(c("a_kinds"), F.lit(0)).eqNullSafe(F.coalesce(c("b_kinds"), F.lit(0))) & c("a_low").eqNullSafe(c("b_low")) & c("a_high").eqNullSafe(c("b_high"))
    change = (
        F.when(~there("b"), "coverage_lost")
        .when(there("a") & (c("a_status") == c("b_status")) & weak("a"), "not_comparable")
        .when(weak("b") | (full("a") & ~full("b")) | (F.coalesce(c("b_examined") < c("a_examined"), F.lit(False)) & ~full("b")), "coverage_lost")
        .when(F.lit(scans.provenance_unknown), "not_comparable")
        .when(F.lit(scans.detector_changed or scans.options_changed) | weak("a"), "not_comparable")
        .when(~there("a"), "new")
        .when(some("a") & ~some("b"), F.when(full("a") & full("b"), "no_longer_observed").otherwise("not_comparable"))
        .when(~same | ~c("a_fingerprint").eqNullSafe(c("b_fingerprint")), "changed")
        .otherwise("unchanged")
    )
    return both.select("object_key", change.alias("change"), c("a_status").alias("before_status"), c("b_status").alias("after_status"))


def comparability(old: DataFrame, new: DataFrame, scans: Scans = Scans()) -> DataFrame:
    """(object_key, gap): why findings of an object can't be compared, or null. One row tells whether all of the
    baseline was covered."""
    covered = old.agg(F.coalesce(F.max(F.when(F.col("status") != "full", 1).otherwise(0)), F.lit(0)).alias("any_gap"))
    both = old.select("object_key", F.col("status").alias("a")).join(new.select("object_key", F.col("status").alias("b")), "object_key", "full_outer").join(F.broadcast(covered))
    gap = (
        F.when(F.lit(scans.provenance_unknown), "detector_provenance_unknown")
        .when(F.lit(scans.detector_changed), "detector_changed")
        .when(F.lit(scans.options_changed), "scan_options_changed")
        .when(F.col("b").isNull(), "current_object_missing")
        .when((F.col("b") != "full") | (F.col("a").isNotNull() & (F.col("a") != "full")), "coverage_not_full")
        .when(F.col("a").isNull() & (F.col("any_gap") == 1), "baseline_coverage_not_full")
    )
    return both.select("object_key", gap.alias("gap"))


def finding_deltas(old: DataFrame, new: DataFrame, old_findings: DataFrame, new_findings: DataFrame, scans: Scans = Scans()) -> DataFrame:
    """Counts before and after by object and identity, for objects whose findings can be compared."""
    scans.check()
    comparable = comparability(old, new, scans).where("gap is null").select("object_key")
    key = lambda f: multisets(f).withColumn("k", F.struct("object_key", *IDENTITY))
    a, b = key(old_findings).select("k", F.col("count").alias("before_count")), key(new_findings).select("k", F.col("count").alias("after_count"))
    both = a.join(b, "k", "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before_count", "after_count")})
    change = F.when(F.col("before_count") == 0, "new").when(F.col("after_count") == 0, "no_longer_observed").when(F.col("before_count") != F.col("after_count"), "changed").otherwise("unchanged")
    return both.select("k.*", "before_count", "after_count", change.alias("change")).join(comparable, "object_key", "left_semi")


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
