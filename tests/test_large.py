"""What large tables need of plans: nothing that grows is broadcast, and work is dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from veilscan.common import durable
from veilscan.operators import evaluate, findings, geometry, layout, spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def boxes(spark):
    return spark.range(20).select("id", F.lit(1).alias("page"), F.lit(0.1).alias("left"), F.lit(0.1).alias("top"), F.lit(0.2).alias("right"), F.lit(0.2).alias("bottom"))


def test_boxes_and_written_tables_are_not_broadcast(spark, boxes):
    for met in (spatial.meeting(boxes, boxes, "page", same=True), spatial.owners(boxes, boxes, "page"), durable(boxes).where("id > 3").groupBy("id").count().join(boxes, "id")):
        assert "SortMergeJoin" in plan(met) and "Broadcast" not in plan(met)
    assert spatial.meeting(boxes, boxes, "page", same=True).count() == 190


def test_pages_are_dealt_to_tasks_and_span_batches(spark):
    words = spark.range(60).select(
        (F.col("id") % 20).alias("page"), F.when(F.col("id") < 20, "MRN: ").otherwise("Diagnosis: ").alias("text"), F.lit(0.1).alias("left"), (0.1 + F.floor(F.col("id") / 20) * 0.03).alias("top"),
        F.lit(0.2).alias("right"), (0.12 + F.floor(F.col("id") / 20) * 0.03).alias("bottom"), F.lit(1).alias("block"), F.lit(1).alias("line"), F.col("id").alias("ordinal"),
    ).withColumn("text", F.trim("text"))
    found = layout.page_regions(words, ["page"])
    assert found.rdd.getNumPartitions() == 4
    whole = sorted(map(str, found.collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted(map(str, layout.page_regions(words, ["page"]).collect())) == whole and len(whole) >= 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_costly_rows_are_dealt_by_number(spark):
    one = spark.range(3).select("id", F.lit("MRN: C0001").alias("text"), F.lit("<html/>").alias("markup"), F.lit("x").alias("tsv"), F.lit(1).alias("pixel_width"), F.lit(1).alias("pixel_height"))
    seen = one.select(F.col("id").alias("object"), F.lit("a").alias("label"), F.lit("b").alias("reason"))
    for df in (findings.detect(one, "id", "text"), geometry.markup_words(one, ["id"]), geometry.tsv_words(one, ["id"]), evaluate.reconciled(seen, seen.withColumn("match_count", F.lit(1)))):
        assert "REPARTITION_BY_NUM" in plan(df)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_windows_of_one_page_need_one_shuffle(spark):
    pages = spark.range(3).select("id", F.lit("x").alias("tsv"), F.lit(1).alias("pixel_width"), F.lit(1).alias("pixel_height"))
    assert plan(geometry.tsv_words(pages, ["id"])).count("Exchange ") == 1


def test_counts_agree_by_object(spark):
    seen = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (3, "a", None), (4, "a", "x")], "object int, label string, reason string")
    final = spark.createDataFrame([(1, "a", "x", 2), (2, "a", "x", 1), (2, "b", "x", 1), (3, "a", None, 1), (4, "a", "x", 1), (4, None, "x", None)], "object int, label string, reason string, match_count int")
    assert sorted(r["object"] for r in evaluate.reconciled(seen, final).collect()) == [1, 1, 4]
