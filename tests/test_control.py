"""Requests to scans, what is let go of, comparisons as shown, and cells as objects: edges."""

from datetime import datetime

from pyspark.sql import functions as F

from veilscan.operators import columns, control
from veilscan.sources.options import Options


def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


SCANS = "scan_id string, source_id string, status string, heartbeat_at timestamp"


def test_requests_follow_the_states(spark):
    fresh, stale = datetime(2024, 1, 1, 23, 59, 50), datetime(2024, 1, 1)
    scans = spark.createDataFrame([("a", "x", "paused", fresh), ("b", "x", "paused", stale), ("c", "x", "completed", fresh), ("d", "x", "interrupted", None), ("e", "x", None, None), ("f", "x", "running", fresh)], SCANS)
    asked = spark.createDataFrame([("a", "resume", 1), ("b", "resume", 1), ("c", "cancel", 1), ("d", "cancel", 1), ("e", "pause", 1), ("f", "pause", 2), ("f", "dance", 1), ("z", "pause", 1)], "scan_id string, action string, at int")
    got = {r["scan_id"]: (r["status"], r["accepted"], r["heartbeat_at"] is None) for r in control.acted(scans, asked, now()).collect()}
    assert got == {"a": ("running", True, False), "b": ("queued", True, True), "c": ("completed", False, False), "d": ("cancelled", True, True), "e": (None, False, True), "f": ("running", False, False)}
    none = control.acted(scans, asked.limit(0), now()).collect()
    assert {r["accepted"] for r in none} == {None} and len(none) == 6


def test_refusals_and_candidates(spark):
    scans = spark.createDataFrame([("a", "x", "running", None), ("b", "x", "completed", None), ("c", "y", "completed", None), ("d", None, "queued", None)], SCANS)
    sources = spark.createDataFrame([("x", True), ("y", True), ("z", None), (None, True)], "source_id string, enabled boolean")
    assert {r["source_id"]: r["refusal"] for r in control.refusals(sources, scans).collect()} == {"x": "active_scan", "y": None, "z": "source_disabled", None: None}
    ids = lambda b: sorted(r["scan_id"] for r in control.candidates(scans, b).collect())
    assert ids("b") == ["a"] and ids("c") == [] and ids("unknown") == ["a", "b", "c", "d"]


def test_a_pass_lets_go_of_the_oldest(spark):
    rows = spark.createDataFrame([(i, datetime(2024, 1, i)) for i in (1, 2, 3)] + [(9, None)], "session_id int, expires_at timestamp")
    left = lambda n: sorted(r["session_id"] for r in control.sessions_left(rows, now(), n).collect())
    assert left(1) == [2, 3, 9] and left(100) == [3, 9]
    empty = rows.limit(0)
    counts = control.expired_counts(empty.select(F.col("expires_at").alias("created_at")), rows, empty.select(F.col("expires_at").alias("at")), now()).collect()
    assert [tuple(r) for r in counts] == [(0, 2, 0)]


def test_counts_that_can_not_be_read_spoil_their_object(spark):
    changes = spark.createDataFrame([(i, "changed", True) for i in range(5)] + [(5, "unchanged", None)], "object_key int, change string, comparable boolean")
    deltas = spark.createDataFrame([(0, "new", 0, 1), (0, "unchanged", 1, 1), (1, "new", None, 1), (2, "new", 0, 2**53), (3, "odd", 0, 1)], "object_key int, change string, before_count long, after_count long")
    got = {r["object_key"]: (r["reason"], r["changed"], r["unchanged"]) for r in control.shown_deltas(changes, deltas).collect()}
    bad = ("counts_unavailable", None, None)
    assert got == {0: (None, 1, 1), 1: bad, 2: bad, 3: bad, 4: (None, 0, 0), 5: ("findings_unavailable", None, None)}
    assert {r["reason"] for r in control.shown_deltas(changes, deltas, True).collect()} == {"detector_or_policy_changed"}


def test_examples_stand_in_the_cell(spark):
    rows = [(1, "MRN: C0001\n\nlater diabetes"), (2, None), (3, ""), (4, '{"note": "diabetes"}'), (5, "ok")]
    cells = columns.cells(spark.createDataFrame(rows, "_row long, diagnosis string"), set(), 1_000)
    found = columns.cell_evidence(cells).collect()
    said = dict(rows)
    assert {(r["entity_type"], r["segment"].split("/")[0], r["value"]) for r in found} == {("MRN", "scan_row:1", "C0001"), ("HEALTH_INFORMATION", "scan_row:1", "diabetes"), ("HEALTH_INFORMATION", "scan_row:4", "diabetes")}
    for r in found:
        assert r["value"] in said[int(r["segment"].split("/")[0].split(":")[1])] and "diagnosis: " not in r["excerpt"] and r["excerpt"][r["start"] :].startswith(r["value"])


def test_entities_stop_at_their_cap(spark):
    table = spark.createDataFrame([("p", str(i), "MRN: C0001" if i else None) for i in range(4)] + [("q", "0", "x")], "PartitionKey string, RowKey string, note string")
    coverage, found = columns.scan_entities(table, Options(max_files=2), partition="p")
    last = [r for r in coverage.collect() if r["location"] == "[cloud-coverage]"]
    assert [(r["status"], r["reason"], r["examined"]) for r in last] == [("sampled", "bounded_prefix_sample", 2)] and coverage.count() == 3
    assert [(r["entity_type"], r["segment"]) for r in found.collect()] == [("MRN", "property:note")]
    coverage, found = columns.scan_entities(table.limit(0))
    assert [tuple(r) for r in coverage.collect()] == [("[cloud-coverage]", "full", None, 0)] and found.count() == 0
