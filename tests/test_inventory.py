"""Tables of a source: which may be read, how, and that one which can't be read stops no other."""

import pytest

from veilscan.sources import inventory as I
from veilscan.sources.options import Options
from veilscan.sources.scan import scan

FOUND = [("a", "BASE TABLE", "InnoDB"), ("v", "VIEW", None), ("m", "BASE TABLE", "MyISAM"), ("w", "BASE TABLE", "INNODB"), ("n", "BASE TABLE", None), (None, "BASE TABLE", "InnoDB"), ("a", "BASE TABLE", "InnoDB")]


def rows(df):
    return {r["location"]: (r["status"], r["reason"]) for r in df.collect()}


def test_every_table_has_a_row(spark):
    found = spark.createDataFrame(FOUND, "table string, type string, engine string")
    grants = spark.createDataFrame([("a", "Select"), ("w", "SELECT"), ("w", "insert")], "table string, privilege string")
    assert rows(I.judged(found, "mysql", grants=grants)) == {"a": (None, None), "v": ("excluded", I.VIEW), "m": ("unsupported", I.ENGINE), "n": ("unsupported", I.ENGINE), "w": ("failed", I.FAILED)}
    asked = spark.createDataFrame([("m",), ("x y",), ("x y",), (None,)], "table string")
    assert rows(I.judged(found, "mssql", asked)) == {"m": (None, None), "x%20y": ("inaccessible", I.ABSENT)}
    assert I.judged(found.limit(0), "mssql").collect() == []


@pytest.mark.parametrize("n", [1_000, 1_001])
def test_limit_of_tables(spark, n):
    found = spark.range(n).selectExpr("format_string('t%05d', id) as table", "'BASE TABLE' as type", "cast(null as string) as engine")
    got = rows(I.judged(found, "postgresql"))
    assert len(got) == n and ("[inventory]" in got) == (n > 1_000) and got["t00999"] == (None, None)


def test_queries_of_tables(spark):
    columns = spark.createDataFrame([("a", "k", "INT", 2), ("a", "b", "BLOB", 1), ("w", "x", "text", 1)], "table string, column string, type string, position int")
    keys = spark.createDataFrame([("a", "k", 1), ("a", "j", 2)], "table string, column string, position int")
    shapes = I.described(columns, keys)
    assert {r["table"]: ([tuple(c) for c in r["columns"]], r["key"]) for r in shapes.collect()} == {"a": ([("b", True), ("k", False)], ["k", "j"]), "w": ([("x", False)], [])}
    found = spark.createDataFrame(FOUND, "table string, type string, engine string")
    queries, bare = I.queries_of(I.judged(found, "mysql"), shapes.where("table = 'a'"), "mysql", Options())
    assert list(queries) == ["a"] and bare == ["w"] and "NULL AS `b`" in queries["a"] and queries["a"].endswith("ORDER BY `k`, `j` LIMIT 1001")


def test_a_damaged_table_stops_no_other(spark, tmp_path):
    spark.createDataFrame([(1, "MRN: A12345")], "id int, note string").write.parquet(str(tmp_path / "good.parquet"))
    spark.createDataFrame([(1, "x")], "id int, note string").coalesce(1).write.parquet(str(tmp_path / "torn.parquet"))
    for f in (tmp_path / "torn.parquet").glob("*.parquet"):
        data = bytearray(f.read_bytes())
        data[4:60] = b"\xff" * 56  # pages are torn, the footer stays
        f.write_bytes(data)
    for f in (tmp_path / "torn.parquet").glob(".*.crc"):
        f.unlink()
    (tmp_path / "no.parquet").write_bytes(b"no parquet at all")
    coverage, findings = scan(spark, "sqlite", {"path": str(tmp_path), "tables": ["torn", "good", "no", "absent"]})
    got = {}
    for r in coverage.collect():
        got.setdefault(r["location"].split("/")[0], set()).add((r["status"], r["reason"]))
    assert got["torn"] == got["no"] == {("failed", I.FAILED)} and got["absent"] == {("inaccessible", I.ABSENT)} and ("full", None) in got["good"]
    assert {r["entity_type"] for r in findings.collect()} == {"MRN"}
