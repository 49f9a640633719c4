"""The catalogue: coverage, listings, overview, reviews, evidence and exports over scans, objects and findings.

Tables: sources (source_id, name, kind, config), scans (scan_id, source_id, status, created_at, ...), objects (scan_id,
object_key, location, status, reason, examined, unit, fingerprint), findings (finding_id, scan_id, object_key, ...).
Scans are written whole, in a partition of their own, so readers of one prune the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import STATUSES
from ..functions.text import csv_guard
from ..sources.options import SECRETS

REVIEWS = ("confirmed", "false_positive", "needs_review")
TABLES = ("objects", "findings", "evidence")


def known_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("failed")


def write_scan(spark: SparkSession, path: str, scan_id: str, **tables: DataFrame) -> None:
    """Write a scan's tables, each in one go; writing it again replaces it and nothing else."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(name)
        df.write.mode("overwrite").parquet(f"{path}/{name}/scan_id={scan_id}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/scan_id=*")


def coverage(objects: DataFrame) -> DataFrame:
    """Objects by status, with their share in percent and whether they are a gap.

    The total is one row, summed from the counts.
    """
    counts = objects.groupBy(known_status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("status", "n", (F.col("n") * 100 / F.col("total")).alias("percent"), (F.col("status") != "full").alias("gap"))


def coverage_rollup(objects: DataFrame, *by: str) -> DataFrame:
    """An extension: counts by all prefixes of `by`, ending with the total."""
    return objects.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def finding_counts(parents: DataFrame, findings: DataFrame, *key: str) -> DataFrame:
    """Parents with the number of their findings; 0 for those without."""
    counts = findings.groupBy(*key).agg(F.count(F.lit(1)).alias("findings"))
    return parents.join(counts, list(key), "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("long"))


def overview(sources: DataFrame, scans: DataFrame, objects: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of totals."""
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    one = n(sources, "sources")
    for df, c in ((scans, "scans"), (objects, "objects"), (findings, "findings"), (objects.where("status <> 'full'"), "gaps")):
        one = one.join(F.broadcast(n(df, c)))
    return one


def newest(scans: DataFrame, n: int = 100) -> DataFrame:
    return scans.orderBy(F.desc("created_at"), "scan_id").limit(n)


def oldest_queued(scans: DataFrame) -> DataFrame:
    return scans.where("status = 'queued'").orderBy("created_at", "scan_id").limit(1)


def listing(findings: DataFrame, objects: DataFrame, scans: DataFrame, sources: DataFrame, scan_id: str | None = None, review: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Findings with location, coverage, detector and source. Filters reach the scan of `findings`."""
    for column, value in (("scan_id", scan_id), ("review_status", review), ("entity_type", entity_type)):
        if value is not None:
            findings = findings.where(F.col(column) == value)
    at = objects.select("scan_id", "object_key", "location", F.col("status").alias("coverage_status"))
    by = scans.select("scan_id", "source_id", "detector_version").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return findings.join(at, ["scan_id", "object_key"]).join(by, "scan_id")


def search(listed: DataFrame, query: str) -> DataFrame:
    return listed.where(F.contains(F.lower(F.concat_ws(" ", "location", "entity_type", "classification")), F.lit(query.lower())))


def reviewed(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with the latest decision on each applied: (finding_id, review_status, at)."""
    last = decisions.where(F.col("review_status").isin(*REVIEWS)).groupBy("finding_id").agg(F.max_by("review_status", F.struct("at", "review_status")).alias("_decided"))
    return findings.join(last, "finding_id", "left").withColumn("review_status", F.coalesce("_decided", "review_status")).drop("_decided")


def shown_evidence(evidence: DataFrame, finding_id: str, role: str) -> DataFrame:
    if role not in ("admin", "reviewer"):
        raise PermissionError(role)
    return evidence.where(F.col("finding_id") == finding_id)


def bounded_evidence(examples: Column) -> Column:
    """At most three examples, with value and excerpt cut to what may be kept."""
    valid = F.filter(examples, lambda x: x["value"].isNotNull() & (F.char_length(x["value"]) > 0))
    return F.slice(F.transform(valid, lambda x: F.struct(F.substring(x["value"], 1, 256).alias("value"), F.substring(x["excerpt"], 1, 400).alias("excerpt"), x["start"].alias("start"), x["end"].alias("end"))), 1, 3)


def redacted(sources: DataFrame, role: str, config: str = "config") -> DataFrame:
    """Sources with secrets masked; other roles than admin see no configuration."""
    if role != "admin":
        return sources.withColumn(config, F.lit(None).cast(sources.schema[config].dataType))
    return sources.withColumn(config, F.transform_values(config, lambda k, v: F.when(k.isin(*SECRETS) & v.isNotNull() & (v != ""), F.lit("[redacted]")).otherwise(v)))


def csv_findings(listed: DataFrame) -> DataFrame:
    return listed.select(*[csv_guard(F.col(c)).alias(c) for c in ("location", "entity_type", "classification", "match_count", "confidence", "coverage_status", "reason", "review_status", "detector_version")])


def csv_coverage(objects: DataFrame) -> DataFrame:
    return objects.select(*[csv_guard(F.col(c)).alias(c) for c in ("location", "status", "reason", "examined", "unit", "findings")])


def export(df: DataFrame, path: str, form: str) -> None:
    if form == "json":
        df.write.mode("errorifexists").json(path)
    elif form == "csv":
        df.write.mode("errorifexists").option("header", True).option("quoteAll", True).csv(path)
    else:
        raise ValueError(form)
