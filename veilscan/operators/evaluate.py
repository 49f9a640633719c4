"""Accuracy against a gold standard: presence by object, occurrences as multisets, associations as sets."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import spread

# What it takes to meet the target.
TARGET, MIN_POSITIVE, MIN_NEGATIVE = 0.95, 30, 30
LABELS = ("IN_AADHAAR", "IN_PAN", "ABHA", "ABHA_ADDRESS", "INSURANCE_ID", "MRN", "UHID", "EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_OF_BIRTH", "PERSON", "LOCATION", "CREDIT_CARD")


def verdict(precision: Column, recall: Column, positive: Column, negative: Column, complete: Column) -> Column:
    return (
        F.when((positive < MIN_POSITIVE) | (negative < MIN_NEGATIVE) | ~complete, "unvalidated")
        .when(F.coalesce((precision >= TARGET) & (recall >= TARGET), F.lit(False)), "target_met")
        .otherwise("below_target")
    )


def _rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def presence_metrics(gold: DataFrame, found: DataFrame, objects: DataFrame, labels: DataFrame) -> DataFrame:
    """By label: objects that should and do have it. `gold` and `found`: (object, label); `objects`: (object, status).

    Labels without any sample appear with zeros. An object that wasn't scanned counts as failed: coverage is incomplete.
    `labels` is a short list, so every object meets each of them once; both sides are distinct pairs joined by key.
    """
    pairs = objects.select("object", F.coalesce("status", F.lit("failed")).alias("status")).withColumn("label", F.explode(F.array(*[F.lit(r["label"]) for r in labels.distinct().collect()])))
    yes = lambda df, c: df.select("object", "label").distinct().withColumn(c, F.lit(True))
    each = pairs.join(yes(gold, "g"), ["object", "label"], "left").join(yes(found, "f"), ["object", "label"], "left").fillna(False, ["g", "f"])
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g, f = F.col("g"), F.col("f")
    counts = each.groupBy("label").agg(n(g & f).alias("tp"), n(~g & f).alias("fp"), n(g & ~f).alias("fn"), n(~g & ~f).alias("tn"), F.min(F.col("status").isin("full", "sampled")).alias("complete"))
    return _rates(counts).withColumn("verdict", verdict(F.col("precision"), F.col("recall"), F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn"), F.col("complete")))


def occurrence_metrics(gold: DataFrame, observed: DataFrame) -> DataFrame:
    """By label, over multisets of (object, label, value): the lesser count is right, the rest missing or too many."""
    count = lambda df, c: df.groupBy("object", "label", "value").agg(F.count(F.lit(1)).alias(c))
    key = F.struct("object", "label", "value")
    both = count(gold, "g").withColumn("k", key).select("k", "g").join(count(observed, "o").withColumn("k", key).select("k", "o"), "k", "full_outer").fillna(0, ["g", "o"])
    right = F.least("g", "o")
    counts = both.groupBy(F.col("k.label").alias("label")).agg(F.sum(right).alias("tp"), F.sum(F.col("o") - right).alias("fp"), F.sum(F.col("g") - right).alias("fn"))
    return _rates(counts)


def association_metrics(gold: DataFrame, observed: DataFrame) -> DataFrame:
    """Over sets of (record, reference): a right reference in the wrong record is wrong twice."""
    key = F.struct("record", "reference")
    side = lambda df, c: df.select(key.alias("k")).distinct().withColumn(c, F.lit(1))
    both = side(gold, "g").join(side(observed, "o"), "k", "full_outer").fillna(0, ["g", "o"])
    counts = both.agg(F.coalesce(F.sum(F.col("g") * F.col("o")), F.lit(0)).alias("tp"), F.coalesce(F.sum((1 - F.col("g")) * F.col("o")), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col("g") * (1 - F.col("o"))), F.lit(0)).alias("fn"))
    return _rates(counts)


def reconciled(observations: DataFrame, findings: DataFrame) -> DataFrame:
    """Observations of objects whose counts all agree with the final findings; others have a gap and give none."""
    key = ("object", "label", "reason")
    zero = F.lit(0).cast("long")
    marks = observations.select(*key, F.lit(1).cast("long").alias("seen"), zero.alias("final")).unionByName(findings.select(*key, zero.alias("seen"), F.col("match_count").cast("long").alias("final")))
    # Two sums instead of a join of counts; everything is dealt by object once.
    both = spread(marks, "object").groupBy(*key).agg(F.sum("seen").alias("seen"), F.coalesce(F.sum("final"), zero).alias("final"))
    # A count without a label or reason has no counterpart.
    told = F.col("label").isNotNull() & F.col("reason").isNotNull()
    agree = F.when(told, F.col("seen") == F.col("final")).otherwise((F.col("seen") == 0) & (F.col("final") == 0))
    agreed = both.groupBy("object").agg(F.min(agree).alias("agree")).where("agree")
    return spread(observations, "object").join(agreed.select("object").hint("merge"), "object", "left_semi")


def leakage(calibration: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Ids and contents that both splits have."""
    by = lambda c: calibration.select(F.col(c).alias("value")).intersect(evaluation.select(F.col(c).alias("value"))).select(F.lit(c).alias("kind"), F.col("value").cast("string").alias("value"))
    return by("id").unionByName(by("content_hash"))


def duplicates(objects: DataFrame, *key: str) -> DataFrame:
    return objects.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def blockers(metrics: DataFrame) -> DataFrame:
    """Why a label's figures can't be accepted; empty if they can."""
    low = lambda c, n, why: F.when(c < n, why)
    reasons = F.array(
        low(F.col("tp") + F.col("fn"), MIN_POSITIVE, "positive_evidence_insufficient"), low(F.col("fp") + F.col("tn"), MIN_NEGATIVE, "negative_evidence_insufficient"), F.when(~F.col("complete"), "coverage_incomplete"),
        F.when(F.coalesce(F.col("precision"), F.lit(0.0)) < TARGET, "precision_below_target"), F.when(F.coalesce(F.col("recall"), F.lit(0.0)) < TARGET, "recall_below_target"),
    )
    return metrics.select("label", F.filter(reasons, lambda x: x.isNotNull()).alias("blockers"))


def read_manifest(text: str) -> dict[str, Any]:
    """A manifest of version 1, 2 or 3 without repeated fields, whose samples have unique ids and known labels."""

    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a field occurs twice")
        return dict(pairs)

    manifest = json.loads(text, object_pairs_hook=unique)
    if manifest.get("schema_version") not in (1, 2, 3) or manifest.get("split") not in ("calibration", "evaluation", "heldout"):
        raise ValueError("unknown version or split")
    ids: set[str] = set()
    for source in manifest.get("sources") or []:
        for sample in source.get("samples") or []:
            if sample["id"] in ids:
                raise ValueError(f"sample {sample['id']} occurs twice")
            ids.add(sample["id"])
            if unknown := set(sample.get("expected") or []) - {*LABELS, "HEALTH_INFORMATION", "PATIENT_REFERENCE"}:
                raise ValueError(f"unknown labels: {sorted(unknown)}")
    if not ids:
        raise ValueError("no samples")
    return manifest


def json_records(value: Any, pointer: str = "") -> list[tuple[str, dict]]:
    """Objects of a JSON value by their pointers, parents first."""
    found, stack = [], [(pointer, value)]
    while stack:
        at, v = stack.pop()
        inner = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
        if isinstance(v, dict):
            found.append((at, v))
        stack += [(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", x) for k, x in reversed(inner) if isinstance(x, (dict, list))]
    return found
