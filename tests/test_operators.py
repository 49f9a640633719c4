import json

import pytest
from pyspark.sql import functions as F

from veilscan.functions.text import location, same_etag
from veilscan.operators import catalog, columns, compare, evaluate, graph, retention, spatial
from veilscan.sources.files import cloud_gate, entries, scan_files
from veilscan.sources.options import InvalidOptions, Options, gate, normalized_config, private_address, redacted_config, wide_row_limits
from veilscan.sources.scan import scan
from veilscan.sources.tables import entities, inventory, projection


def test_options():
    assert Options.of({"max_files": 5}).max_files == 5
    for bad in ({"max_files": True}, {"max_files": 0}, {"max_files": 10**9}, {"full_scan": 1}, {"other": 1}):
        with pytest.raises(InvalidOptions):
            Options.of(bad)
    assert gate("ftp", Options()) == ("unsupported", "source_kind_not_supported")
    assert gate("postgresql", Options(full_scan=True)) == ("excluded", "full_scan_not_approved")
    assert gate("postgresql", Options(full_scan=True), True) == ("excluded", "full_scan_requires_explicit_tables")
    assert gate("postgresql", Options(full_scan=True), True, ["t"]) is None
    assert Options().comparable() == Options(capture_evidence=True).comparable()
    cell, batch = wide_row_limits(1000, 65_536, 100)
    assert 1000 * cell * 4 <= 1 << 20 and batch * 1000 * cell * 4 <= 8 << 20


def test_configs():
    assert normalized_config("sqlite", {"path": " a ", "tables": "x, y\nx,"})["tables"] == ["x", "y"]
    with pytest.raises(InvalidOptions):
        normalized_config("filesystem", {"root": "relative"})
    assert private_address("10.0.0.1") and private_address("localhost") and not private_address("8.8.8.8") and not private_address("example.com")
    assert redacted_config({"password": "p", "host": "h"}) == {"password": "[redacted]", "host": "h"}
    assert projection("mssql", "dbo.t]x", [("a", False), ("b", True)], ["a"], Options(table_sample_rows=2)).startswith("SELECT TOP (3) LEFT(CAST([a] AS NVARCHAR(MAX))")
    assert [x[2:] for x in inventory([("v", "VIEW"), ("t", "TABLE"), ("u", "TABLE")], 2)] == [("excluded", "database_views_not_scanned"), (None, None), ("partial", "database_table_inventory_limit")]


def test_columns_of_a_table(spark):
    rows = [(1, "A123", "diagnosis diabetes", bytearray(b"x")), (2, "B456", None, None), (3, "C789", "fine", None)]
    visits = spark.createDataFrame(rows, "id int, mrn string, note string, scan binary")
    coverage, found = columns.scan_table(visits, "visits", Options(table_sample_rows=2), ["id"])
    got = {r["column"]: r for r in coverage.collect()}
    assert {c: (r["status"], r["examined"], r["nonempty"]) for c, r in got.items()} == {"id": ("sampled", 2, 2), "mrn": ("sampled", 2, 2), "note": ("sampled", 2, 1), "scan": ("unsupported", 0, 0)}
    assert got["scan"]["fingerprint"] is None and len(got["note"]["fingerprint"]) == 64
    assert {(r["location"], r["entity_type"], r["classification"], r["match_count"]) for r in found.collect()} == {("visits/mrn", "MRN", "personal_data", 2), ("visits/note", "HEALTH_INFORMATION", "patient_linked_health", 2)}


def test_fingerprints_of_whole_tables(spark):
    def of(rows, parts):
        df = spark.createDataFrame(rows, "id int, note string, scan binary").repartition(parts)
        return {r["column"]: r["fingerprint"] for r in columns.scan_table(df, "t", Options(full_scan=True), ["id"])[0].collect()}

    rows = [(1, "a", None), (2, "b", None), (3, None, None), (4, "", None)]
    first = of(rows, 1)
    assert of(rows[::-1], 3) == first and first["scan"] is None and len(first["note"]) == 64
    for other in ([(1, "b", None), (2, "a", None), *rows[2:]], [*rows, rows[0]], [*rows[:2], (3, "", None), (4, None, None)]):
        assert of(other, 2)["note"] != first["note"]


def test_columns_with_a_patients_key(spark):
    keys = [("labs", "patients", ["id"], ["subject"]), ("labs", "wards", ["id"], ["ward"]), ("notes", "people", [None, "MRN"], ["who"]), ("wards", None, None, ["x"]), ("bare", "the_patient_list", ["id"], None)]
    fks = spark.createDataFrame(keys, "table string, referred_table string, referred_columns array<string>, constrained_columns array<string>")
    named = spark.createDataFrame([("labs", ["ref", "subject", None]), ("beds", []), ("stays", ["ref"])], "table string, columns array<string>")
    fk, own = columns.DECLARED, columns.CONFIGURED
    assert {(r["table"], *r["columns"], *r["evidence"]) for r in columns.patient_columns(fks, named).collect()} == {("labs", "ref", "subject", fk, own), ("notes", "who", fk), ("bare", fk), ("stays", "ref", own)}
    assert columns.patient_columns(fks.limit(0)).count() == 0


def test_declared_patient_columns(spark):
    labs = spark.createDataFrame([(1, "p7", "diabetes"), (2, "p8", '{"x": ')], "id int, subject string, diagnosis string")
    coverage, found = columns.scan_table(labs, "a/b", Options(), ["id"], {"subject"})
    assert {(r["location"], r["entity_type"], r["classification"], r["match_count"]) for r in found.collect()} >= {("a%2Fb/subject", "PATIENT_REFERENCE", "personal_data", 2), ("a%2Fb/diagnosis", "HEALTH_INFORMATION", "patient_linked_health", 2)}
    assert {r["status"] for r in coverage.where("column = 'diagnosis'").collect()} == {"partial"}


def test_empty_table(spark):
    coverage, found = columns.scan_table(spark.createDataFrame([], "id int, mrn string"), "t", Options(), ["id"])
    assert {(r["status"], r["examined"]) for r in coverage.collect()} == {("full", 0)} and found.count() == 0


def test_locations_and_tags(spark):
    df = spark.createDataFrame([("a/b", "c", '"t"', "t"), ("a", "b/c", None, None)], "x string, y string, e string, f string")
    got = df.select(location(F.col("x"), F.col("y")).alias("l"), same_etag(F.col("e"), F.col("f")).alias("s")).collect()
    assert [r["l"] for r in got] == ["a%2Fb/c", "a/b%2Fc"] and [r["s"] for r in got] == [True, False]


def objects(spark, *rows):
    return spark.createDataFrame([(k, s, e, f) for k, s, e, f in rows], "object_key string, status string, examined long, fingerprint string")


def counts(spark, *rows):
    return spark.createDataFrame([(k, t, "personal_data", None, "s", n) for k, t, n in rows], "object_key string, entity_type string, classification string, reason string, segment string, match_count long")


def test_changes(spark):
    old = objects(spark, ("gone", "full", 1, "a"), ("same", "full", 1, "a"), ("less", "full", 1, "a"), ("lost", "full", 1, "a"), ("print", "full", 1, None), ("weak", "partial", 1, "a"), ("weaker", "partial", 1, "a"), ("shrunk", "sampled", 9, "a"))
    new = objects(spark, ("same", "full", 1, "a"), ("less", "full", 1, "a"), ("lost", "sampled", 1, "a"), ("print", "full", 1, "b"), ("weak", "partial", 1, "a"), ("weaker", "full", 1, "a"), ("shrunk", "sampled", 3, "a"), ("new", "full", 1, "a"))
    before, after = counts(spark, ("same", "MRN", 2), ("less", "MRN", 1)), counts(spark, ("same", "MRN", 1), ("same", "MRN", 1))
    got = {r["object_key"]: r["change"] for r in compare.object_changes(old, new, before, after).collect()}
    assert got == {"gone": "coverage_lost", "same": "unchanged", "less": "no_longer_observed", "lost": "coverage_lost", "print": "changed", "weak": "not_comparable", "weaker": "not_comparable", "shrunk": "coverage_lost", "new": "new"}
    assert {r["change"] for r in compare.object_changes(old, new, before, after, compare.Scans(provenance_unknown=True)).where("object_key = 'same'").collect()} == {"not_comparable"}
    deltas = {(r["object_key"], r["change"]) for r in compare.finding_deltas(old, new, before, after).collect()}
    assert deltas == {("same", "unchanged"), ("less", "no_longer_observed")}
    with pytest.raises(ValueError):
        compare.object_changes(old, new, before, after, compare.Scans(both_completed=False))


def test_metrics(spark):
    gold = spark.createDataFrame([("o", "MRN", str(i)) for i in range(100)], "object string, label string, value string")
    r = evaluate.occurrence_metrics(gold, gold.where("value = '7'")).first()
    assert (r["recall"], r["precision"]) == (0.01, 1.0)
    pairs = lambda *x: spark.createDataFrame(x, "record string, reference string")
    r = evaluate.association_metrics(pairs(("1", "A"), ("2", "B")), pairs(("1", "B"), ("2", "A"))).first()
    assert (r["tp"], r["fp"], r["fn"]) == (0, 2, 2)
    seen = spark.createDataFrame([("o", "MRN", "r"), ("p", "MRN", "r")], "object string, label string, reason string")
    final = spark.createDataFrame([("o", "MRN", "r", 1), ("p", "MRN", "r", 2)], "object string, label string, reason string, match_count long")
    assert [r["object"] for r in evaluate.reconciled(seen, final).collect()] == ["o"]
    assert evaluate.json_records({"a": [{"b/c": {}}]}) == [("", {"a": [{"b/c": {}}]}), ("/a/0", {"b/c": {}}), ("/a/0/b~1c", {})]
    with pytest.raises(ValueError):
        evaluate.read_manifest('{"schema_version": 1, "schema_version": 1}')
    assert evaluate.read_manifest(json.dumps({"schema_version": 1, "split": "heldout", "sources": [{"samples": [{"id": "1", "expected": ["MRN"]}]}]}))


def test_catalogue(spark, tmp_path):
    df = objects(spark, ("a", "full", 1, "x"), ("b", "odd", 1, "x"))
    catalog.write_scan(spark, str(tmp_path), "s1", objects=df)
    catalog.write_scan(spark, str(tmp_path), "s1", objects=df)
    back = catalog.read_table(spark, str(tmp_path), "objects")
    assert back.count() == 2 and {r["status"]: r["percent"] for r in catalog.coverage(back).collect()} == {"full": 50.0, "failed": 50.0}
    sources = spark.createDataFrame([(1, {"password": "x", "host": "h"})], "source_id int, config map<string,string>")
    assert catalog.redacted(sources, "admin").first()["config"] == {"password": "[redacted]", "host": "h"}
    assert catalog.redacted(sources, "reviewer").first()["config"] is None
    with pytest.raises(PermissionError):
        catalog.shown_evidence(df, "1", "operator")


def test_retention(spark):
    now = F.lit("2026-01-31").cast("timestamp")
    scans = spark.sql("select 's' || id as scan_id, timestamp'2026-01-01' + make_dt_interval(id) as created_at, 'running' as status, 'src' as source_id from range(3)")
    due, left = retention.purge(scans, now)
    assert [r["scan_id"] for r in due.collect()] == ["s0"] and left.count() == 2
    assert retention.purge(scans, now, approved=False)[0].count() == 0
    assert {r["status"] for r in retention.drained(scans).collect()} == {"interrupted"}
    import hashlib
    import hmac

    key = hmac.new(b"k", ("src:" + hashlib.sha256(b"loc").hexdigest()).encode(), hashlib.sha256).hexdigest()
    held = spark.createDataFrame([("s0", "loc", key), ("s0", "loc", "no")], "scan_id string, location string, object_key string")
    assert retention.verify_restored(scans, held, b"k").first()["mismatched"] == 1


def test_spatial_and_graph(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5, 0.5), (1, 2, 0.4, 0.4, 0.9, 0.9), (1, 3, 0.5, 0.0, 0.6, 0.1), (2, 4, 0.0, 0.0, 1.0, 1.0)], "page int, id int, left double, top double, right double, bottom double")
    assert [(r["a"], r["b"]) for r in spatial.overlapping(boxes, boxes, "page", same=True).collect()] == [(1, 2)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "a int, b int")
    got = graph.components(edges, spark.range(1, 25).select(F.col("id").cast("int").alias("id")))
    assert {r["component"] for r in got.where("id <= 20").collect()} == {1} and got.where("id = component").count() == 5


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("mrn,diagnosis\nA123,diabetes\n")
    (tmp_path / "b.zip").write_bytes(b"x")
    (tmp_path / "c.txt").write_text("x" * 100)
    (tmp_path / "link").symlink_to(tmp_path / "c.txt")
    got = {r["location"].rsplit("/", 1)[-1]: (r["status"], r["reason"]) for r in scan_files(spark, str(tmp_path), Options(max_file_bytes=50)).where("location not like '%link'").collect()}
    assert got == {"a.csv": ("full", None), "b.zip": ("excluded", "archive_scanning_disabled"), "c.txt": ("excluded", "file_size_limit")}
    assert {(r["path"].rsplit("/", 1)[-1], r["kind"]) for r in entries(spark, str(tmp_path)).collect()} == {("a.csv", "file"), ("b.zip", "file"), ("c.txt", "file"), ("link", "symlink")}
    coverage, found = scan(spark, "filesystem", {"root": str(tmp_path / "in")})
    assert coverage.count() == 1 and ("HEALTH_INFORMATION", "patient_linked_health") in {(r["entity_type"], r["classification"]) for r in found.collect()}
    assert scan(spark, "filesystem", {"root": "no"})[0].first()["reason"] == "source_scan_failed"
    assert scan(spark, "filesystem", {}, {"max_files": 0})[0].first()["reason"] == "invalid_scan_options"


def test_links_special_files_and_the_cap(spark, tmp_path):
    import os

    outside = tmp_path / "outside"
    (outside / "folder").mkdir(parents=True)
    (outside / "secret.txt").write_text("mrn A123")
    (outside / "folder/other.txt").write_text("x")
    root = tmp_path / "root"
    root.mkdir()
    for n in "abc":
        (root / f"{n}.txt").write_text(n)
    (root / "link.txt").symlink_to(outside / "secret.txt")
    (root / "tree").symlink_to(outside / "folder")
    os.mkfifo(root / "pipe.txt")
    got = {r["location"].rsplit("/", 1)[-1]: (r["status"], r["reason"], r["text"]) for r in scan_files(spark, str(root)).collect()}
    assert got == {"a.txt": ("full", None, "a"), "b.txt": ("full", None, "b"), "c.txt": ("full", None, "c"), "link.txt": ("excluded", "symlink_excluded", None), "tree": ("excluded", "symlink_excluded", None), "pipe.txt": ("excluded", "special_file_excluded", None)}
    capped = {r["location"].rsplit("/", 1)[-1]: (r["status"], r["reason"]) for r in scan_files(spark, str(root), Options(max_files=2)).collect()}
    assert capped == {"a.txt": ("full", None), "b.txt": ("full", None), "[coverage]": ("partial", "file_limit_reached")}


def test_components_reach_the_end_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(9000, 9001), (9001, 9001)], "a int, b int")
    got = {r["id"]: r["component"] for r in graph.components(edges, spark.createDataFrame([(5,), (7777,), (None,)], "id int")).collect()}
    assert got == {**{i: 0 for i in range(3001)}, 9000: 9000, 9001: 9000, 7777: 7777}


def test_stores_and_entities(spark):
    df = spark.createDataFrame([("a.txt", 10, "t"), ("a.txt", None, "t"), ("a.txt", 10, None), ("a.gz", 1, "t")], "path string, size long, etag string")
    status, reason = cloud_gate(F.col("size"), F.col("path"), F.col("etag"), Options())
    assert [r["r"] for r in df.select(reason.alias("r")).collect()] == [None, "object_size_unavailable", "object_version_unavailable", "archive_scanning_disabled"]
    one = entities(spark.createDataFrame([("p", "r", "v")], "PartitionKey string, RowKey string, note string"))
    assert {r["segment"] for r in one.collect()} == {"property:PartitionKey", "property:RowKey", "property:note"}
