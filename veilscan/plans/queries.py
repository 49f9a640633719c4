"""Queries over the given tables, one or more for each operator, and the same in ANSI SQL where it can express them.

Where the tables lack identifiers, records and boxes, both sides derive the same ones from keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import ship, spread
from ..functions.recognizers import CARDS, RULES
from ..functions.structured import page_text_udf, render_udf
from ..functions.text import bounded, csv_guard, location, object_key, segments, structured_kind, windows
from ..operators import accounts, catalog, channels, columns, compare, control, evaluate, findings, geometry, graph, layout, retention, sheets, spatial
from ..sources import inventory
from ..sources.options import Options
from ..sources.tables import parquet_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


t = parquet_table
# What a text holds by itself: recognizers that need no label, each from left to right without overlap. Characters before
# and after a match decide but aren't part of it, so a match's last character is what stands before the next one. Texts
# of `documents` have no labels of identifiers, no clinical terms and one segment each; those rules aren't stated here.
VERHOEFF = "[[0,1,2,3,4,5,6,7,8,9],[1,5,7,6,2,8,3,0,9,4],[5,8,0,3,7,9,6,1,4,2],[8,9,1,6,0,4,3,5,2,7],[9,4,5,3,1,2,6,8,7,0],[4,2,8,6,5,7,3,9,0,1],[2,7,9,3,8,0,6,4,1,5],[7,0,4,6,9,1,3,2,5,8]]"
AADHAAR_LIKE = f"""regexp_full_match(s, '[2-9][0-9]{{11}}') AND s <> repeat(left(s, 1), 12) AND list_reduce(list_prepend(0, list_transform(generate_series(0, 11), lambda i: {VERHOEFF}[(i % 8 + 1)::BIGINT][try_cast(substr(s, (12 - i)::BIGINT, 1) AS INTEGER) + 1])),
lambda a, b: CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN (a + b) % 5 + 5 WHEN b < 5 THEN (a - b + 5) % 5 + 5 ELSE (a - b + 10) % 5 END) = 0"""
KINDS = (
    ("IN_AADHAAR", 0.96, "format_and_verhoeff_checksum", "[^0-9]", "[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[^0-9]"),
    ("IN_PAN", 0.9, "pan_format_candidate", r"[^\p{L}\p{N}_]", "(?i:[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z])", r"[^\p{L}\p{N}_]"),
    ("EMAIL_ADDRESS", 0.95, "email_format", r"[^\p{L}\p{N}_.+-]", r"(?i:[A-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Z0-9](?:[A-Z0-9.-]*[A-Z0-9])?\.[A-Z]{2,})", r"[^\p{L}\p{N}_.-]"),
    ("PHONE_NUMBER", 0.75, "indian_phone_format_candidate", r"[^\p{L}\p{N}_]", r"(?:\+?91[ -]?)?[6-9][0-9]{4}[ -]?[0-9]{5}", r"[^\p{Nd}]"),
)
KINDS_SQL = "(VALUES " + ", ".join(f"('{k}', {n}, '{why}', '{pre}', '{core}', '{post}')" for k, n, why, pre, core, post in KINDS) + ") k(kind, confidence, reason, pre, core, post)"
HOLDS_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_matches(t, '(?s){pre}(?:{core})(?:{post}|$)')" for k, _, _, pre, core, post in KINDS) + " END"
TAKE = "regexp_extract({0}, '(?s)^(.*?' || pre || ')(?:' || core || ')(?:' || post || '|$)', 1) AS head, regexp_extract({0}, '(?s)^.*?' || pre || '(' || core || ')(?:' || post || '|$)', 1) AS span"
SPANS_SQL = f"""(WITH RECURSIVE k AS (SELECT * FROM {KINDS_SQL}), d AS (SELECT doc_id, chr(10) || text AS t FROM documents),
w AS (SELECT doc_id, kind, confidence, reason, pre, core, post, t AS rest, 0::BIGINT AS passed, {TAKE.format("t")} FROM d, k WHERE {HOLDS_SQL}
UNION ALL SELECT doc_id, kind, confidence, reason, pre, core, post, rest, passed, {TAKE.format("rest")} FROM (SELECT * REPLACE (substr(rest, length(head) + length(span)) AS rest, passed + length(head) + length(span) - 1 AS passed) FROM w WHERE span <> '')),
f AS (SELECT doc_id, kind, confidence, reason, span AS value, passed + length(head) AS b, passed + length(head) + length(span) AS e, regexp_replace(span, '[ -]', '', 'g') AS s FROM w WHERE span <> ''),
g AS (SELECT * FROM f WHERE kind <> 'IN_AADHAAR' OR ({AADHAAR_LIKE}))
SELECT * FROM g WHERE kind <> 'PHONE_NUMBER' OR NOT EXISTS (SELECT 1 FROM g o WHERE o.doc_id = g.doc_id AND o.kind <> 'PHONE_NUMBER' AND o.b <= g.b AND o.e >= g.e))"""
DETECTED_SQL = f"(SELECT doc_id, kind, confidence, reason, count(*)::BIGINT AS n FROM {SPANS_SQL} GROUP BY ALL)"


# Text to findings.


@query(f"SELECT doc_id, kind AS entity_type, 'personal_data' AS classification, confidence::DOUBLE AS confidence, n AS match_count, reason, 'segment:1/block:1/row:1' AS segment FROM {DETECTED_SQL}")
def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.detect(t(spark, d, "documents"), "doc_id", "text").withColumnRenamed("object", "doc_id")


@query(f"SELECT doc_id, i::INTEGER AS example, left(value, 256) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY b) AS i FROM {SPANS_SQL}) WHERE i <= 3")
def evidence_top3(spark: SparkSession, d: str) -> DataFrame:
    return findings.evidence(t(spark, d, "documents"), "doc_id", "text").select(F.col("object").alias("doc_id"), "example", "value")


@query("SELECT conv_id, turn, 'full' AS status, 0::BIGINT AS findings FROM conversations")
def conversation_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    found = findings.detect(c, "id", "text").withColumnRenamed("object", "id")
    return catalog.finding_counts(c.select("id", "conv_id", "turn", F.lit("full").alias("status")), found, "id").drop("id")


@query()
def page_text_findings(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    pages = t(spark, d, "pages").select("page_id", page_text_udf()(F.col("html")).alias("text"))
    return findings.detect(pages, "page_id", "text").withColumnRenamed("object", "page_id")


@query()
def document_cards(spark: SparkSession, d: str) -> DataFrame:
    found = findings.detect(t(spark, d, "documents"), "doc_id", "text", rules=(*RULES, CARDS))
    return found.where("entity_type = 'CREDIT_CARD'").select(F.col("object").alias("doc_id"), "match_count", "segment")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of four kinds: linked, in another paragraph, with two identifiers, and general."""
    k = F.col("c_custkey")
    mrn, end = F.concat(F.lit("MRN: C000"), k), F.lit("\nDiagnosis: diabetes")
    text = F.when(k % 4 == 0, F.concat(mrn, end)).when(k % 4 == 1, F.concat(mrn, F.lit("\n"), end)).when(k % 4 == 2, F.concat(mrn, F.lit(" UHID: U000"), k, end)).otherwise(F.concat(F.lit("General article on diabetes "), k))
    return t(spark, d, "customer").select(k.alias("id"), text.alias("text"))


NOTES_SQL = """
WITH k AS (SELECT c_custkey AS id, c_custkey % 4 AS r FROM customer),
ids AS (SELECT id, 'MRN' AS entity_type, r FROM k WHERE r < 3 UNION ALL SELECT id, 'UHID', r FROM k WHERE r = 2)
SELECT id, entity_type, 'personal_data' AS classification, 0.9::DOUBLE AS confidence, 1::BIGINT AS match_count, 'hospital_identifier_label_and_format' AS reason, 'segment:1/block:1/row:1' AS segment FROM ids
UNION ALL
SELECT id, 'HEALTH_INFORMATION', CASE WHEN r = 0 THEN 'patient_linked_health' ELSE 'clinical_content' END, CASE WHEN r = 0 THEN 0.85 ELSE 0.7 END, CASE WHEN r = 3 THEN 1 ELSE 2 END,
  CASE r WHEN 0 THEN 'clinical_content_with_patient_reference' WHEN 2 THEN 'clinical_content_with_ambiguous_patient_references' ELSE 'clinical_terms_or_field_context' END,
  CASE WHEN r = 1 THEN 'segment:1/block:2/row:1' ELSE 'segment:1/block:1/row:1' END FROM k"""


@query(NOTES_SQL)
def patient_note_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.detect(notes(spark, d), "id", "text").withColumnRenamed("object", "id")


@query(f"SELECT entity_type, classification, reason, max(confidence) AS confidence, sum(match_count)::BIGINT AS match_count FROM ({NOTES_SQL}) GROUP BY ALL")
def merged_note_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.merged(findings.detect(notes(spark, d), "id", "text"), "entity_type", "classification", "reason")


@query("""
WITH k AS (SELECT c_custkey AS id FROM customer),
kinds(kind, confidence, reason) AS (VALUES ('IN_PAN', 0.9, 'pan_format_candidate'), ('ABHA', 0.88, 'abha_format_and_label_candidate'), ('ABHA_ADDRESS', 0.9, 'abha_address_format_candidate'),
  ('INSURANCE_ID', 0.85, 'insurance_identifier_label_and_format'), ('DATE_OF_BIRTH', 0.9, 'birth_date_label_and_format'), ('PHONE_NUMBER', 0.75, 'indian_phone_format_candidate'))
SELECT id, kind AS entity_type, confidence::DOUBLE AS confidence, 1::BIGINT AS match_count, reason FROM k, kinds""")
def labelled_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """One identifier of each kind in every text; the phone's digits within the health number are no phone."""
    k = F.lpad(F.col("c_custkey").cast("string"), 4, "0")
    k4 = F.substring(k, -4, 4)
    text = F.concat(F.lit("PAN ABCPK"), k4, F.lit("F; ABHA number: 91-1876-5"), F.substring(k, -3, 3), F.lit("-"), k4, F.lit("; person"), k, F.lit("@abdm; policy no: POL"), k, F.lit("; DOB: 1980-02-03; call 98765 4"), k4)
    found = findings.detect(t(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")
    return found.select(F.col("object").alias("id"), "entity_type", "confidence", "match_count", "reason")


VERHOEFF_SQL = """
WITH n AS (SELECT c_custkey AS id, (200000000000 + c_custkey * 1234567)::VARCHAR AS s FROM customer),
p AS (SELECT [[0,1,2,3,4,5,6,7,8,9],[1,5,7,6,2,8,3,0,9,4],[5,8,0,3,7,9,6,1,4,2],[8,9,1,6,0,4,3,5,2,7],[9,4,5,3,1,2,6,8,7,0],[4,2,8,6,5,7,3,9,0,1],[2,7,9,3,8,0,6,4,1,5],[7,0,4,6,9,1,3,2,5,8]] AS t),
x AS (SELECT id, s, list_prepend(0, list_transform(generate_series(0, 11), lambda i: t[(i % 8 + 1)::BIGINT][substr(s, (12 - i)::BIGINT, 1)::INTEGER + 1])) AS v FROM n, p),
c AS (SELECT id, s, list_reduce(v, lambda a, b: CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN (a + b) % 5 + 5 WHEN b < 5 THEN (a - b + 5) % 5 + 5 ELSE (a - b + 10) % 5 END) AS r FROM x)
SELECT id, 'IN_AADHAAR' AS entity_type, 1::BIGINT AS match_count FROM c WHERE r = 0 AND regexp_full_match(s, '[2-9][0-9]{11}') AND s <> repeat(left(s, 1), 12)"""


@query(VERHOEFF_SQL)
def checksum_identifiers(spark: SparkSession, d: str) -> DataFrame:
    text = (F.lit(200000000000) + F.col("c_custkey") * 1234567).cast("string")
    found = findings.detect(t(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text").where("entity_type = 'IN_AADHAAR'")
    return found.select(F.col("object").alias("id"), "entity_type", "match_count")


# Segments, windows and structure.


@query(r"""SELECT doc_id, format('segment:1/block:{}/row:1', i) AS segment, length(b[i])::INTEGER AS n FROM
(SELECT doc_id, b, unnest(generate_series(1, len(b))) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n[ \t]*\n') AS b FROM documents))""")
def segment_inventory(spark: SparkSession, d: str) -> DataFrame:
    twice = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    rows = t(spark, d, "documents").select("doc_id", F.explode(segments(twice)).alias("s"))
    return rows.select("doc_id", "s.segment", F.char_length("s.text").alias("n"))


@query("SELECT doc_id, o::INTEGER AS start, length(substr(text, (o + 1)::BIGINT, 12000))::INTEGER AS n FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 11744)) AS o FROM documents WHERE length(text) > 0)")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").select("doc_id", "text", F.explode(windows(F.col("text"))).alias("start"))
    return rows.select("doc_id", "start", F.char_length(F.substring(F.col("text"), F.col("start") + 1, F.lit(12_000))).alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'partial' ELSE 'full' END AS status, CASE WHEN length(text) > 2000 THEN 'text_limit_reached' END AS reason, least(length(text), 2000)::INTEGER AS examined FROM documents")
def text_bound_status(spark: SparkSession, d: str) -> DataFrame:
    text, status, reason = bounded(F.col("text"), 2_000)
    return t(spark, d, "documents").select("doc_id", status.alias("status"), reason.alias("reason"), F.char_length(text).alias("examined"))


@query(r"""SELECT src, kind, count(*) AS n FROM (SELECT 'props' AS src, CASE WHEN regexp_matches(props, '^\s*[{\[]') THEN 'json' END AS kind FROM events
UNION ALL SELECT 'text', CASE WHEN regexp_matches(text, '^\s*[{\[]') THEN 'json' END FROM documents
UNION ALL SELECT 'html', CASE WHEN regexp_matches(html, '^\s*<(\?xml|[A-Za-z_][A-Za-z0-9_:.-]*(\s|>|/))') THEN 'xml' END FROM pages) GROUP BY ALL""")
def structured_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = [t(spark, d, name).select(F.lit(src).alias("src"), structured_kind(F.col(c)).alias("kind")) for name, src, c in (("events", "props", "props"), ("documents", "text", "text"), ("pages", "html", "html"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, trim(props, '{}') AS text FROM events")
def props_records(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return t(spark, d, "events").select("event_id", render_udf()(F.col("props"), structured_kind(F.col("props")))["text"].alias("text"))


@query("SELECT p_partkey, url_encode(p_name) || '/' || url_encode(p_type) AS location, sha256(url_encode(p_name) || '/' || url_encode(p_type)) AS object_key FROM part")
def object_locations(spark: SparkSession, d: str) -> DataFrame:
    at = location(F.col("p_name"), F.col("p_type"))
    return t(spark, d, "part").select("p_partkey", at.alias("location"), object_key(at).alias("object_key"))


# Columns of tables.


@query("""SELECT 'customer/' || c AS location, CASE WHEN n > 1000 THEN 'sampled' ELSE 'full' END AS status, CASE WHEN n > 1000 THEN 'bounded_prefix_sample' END AS reason, least(n, 1000) AS examined, least(n, 1000) AS nonempty
FROM (SELECT count(*) AS n FROM customer), (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) v(c)
UNION ALL SELECT 'nation/' || c, 'full', NULL, n, n FROM (SELECT count(*) AS n FROM nation), (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) v(c)""")
def table_coverage(spark: SparkSession, d: str) -> DataFrame:
    customer, _ = columns.scan_table(t(spark, d, "customer"), "customer", key=["c_custkey"], fingerprint=False)
    nation, _ = columns.scan_table(t(spark, d, "nation"), "nation", key=["n_nationkey"], fingerprint=False)
    return customer.unionByName(nation).select("location", "status", "reason", "examined", "nonempty")


@query("SELECT 'nation/' || c AS location, sha256(string_agg(repeat(chr(0), 7) || chr(length(v)::INTEGER) || v, '' ORDER BY n_nationkey)) AS fingerprint FROM (" + " UNION ALL ".join(f"SELECT n_nationkey, '{c}' AS c, {c}::VARCHAR AS v FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")) + ") GROUP BY c")
def column_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return columns.scan_table(t(spark, d, "nation"), "nation", key=["n_nationkey"])[0].select("location", "fingerprint")


FULL_CELLS_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS c, sha256('{{"c_custkey":' || c_custkey || '}}' || '=' || coalesce('v' || {c}, 'n')) AS h FROM customer""" for c in ("c_custkey", "c_name", "c_mktsegment"))


@query("SELECT 'customer/' || c AS location, sha256(concat_ws(',', " + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8)) + f")) AS fingerprint FROM ({FULL_CELLS_SQL}) GROUP BY c")
def full_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    table = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return columns.scan_table(table, "customer", Options(full_scan=True), ["c_custkey"])[0].select("location", "fingerprint")


def visits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.concat(F.when(k % 5 == 0, "no findings").otherwise("diabetes"), F.when(k % 3 == 0, F.concat(F.lit(", see MRN: X000"), k)).otherwise(""))
    return t(spark, d, "customer").select(F.concat(F.lit("A000"), k).alias("mrn"), said.alias("diagnosis"), k.alias("visit"))


@query("""WITH s AS (SELECT c_custkey AS k FROM customer)
SELECT 'visits/mrn' AS location, 'MRN' AS entity_type, 'personal_data' AS classification, 0.9::DOUBLE AS confidence, count(*)::BIGINT AS match_count, 'hospital_identifier_label_and_format' AS reason FROM s
UNION ALL SELECT 'visits/diagnosis', 'HEALTH_INFORMATION', 'patient_linked_health', 0.85, (count(*) + count(*) FILTER (k % 5 <> 0))::BIGINT, 'clinical_content_with_patient_reference' FROM s WHERE k % 3 <> 0
UNION ALL SELECT 'visits/diagnosis', 'HEALTH_INFORMATION', 'clinical_content', 0.7, (count(*) + count(*) FILTER (k % 5 <> 0))::BIGINT, 'clinical_content_with_ambiguous_patient_references' FROM s WHERE k % 3 = 0
UNION ALL SELECT 'visits/diagnosis', 'MRN', 'personal_data', 0.9, count(*)::BIGINT, 'hospital_identifier_label_and_format' FROM s WHERE k % 3 = 0""")
def row_references(spark: SparkSession, d: str) -> DataFrame:
    """A row's identifier links its diagnosis, unless the diagnosis names another patient."""
    return columns.scan_table(visits(spark, d), "visits", Options(full_scan=True), fingerprint=False)[1].drop("segment")


VISITS_SQL = "(SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'no findings' ELSE 'diabetes' END || CASE WHEN c_custkey % 3 = 0 THEN ', see MRN: X000' || c_custkey ELSE '' END AS said FROM customer)"


@query(f"""WITH e AS (SELECT 'mrn' AS "column", 'MRN' AS entity_type, k, 'A000' || k AS value, 'A000' || k AS excerpt, 0 AS start FROM {VISITS_SQL}
UNION ALL SELECT 'diagnosis', 'HEALTH_INFORMATION', k, 'diabetes', said, 0 FROM {VISITS_SQL} WHERE k % 5 <> 0
UNION ALL SELECT 'diagnosis', 'MRN', k, 'X000' || k, said, length(said) - length('X000' || k) FROM {VISITS_SQL} WHERE k % 3 = 0)
SELECT "column", entity_type, n AS example, 'scan_row:' || k || '/segment:1/block:1/row:1' AS segment, value, excerpt, start, start + length(value) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY "column", entity_type ORDER BY k) AS n FROM e) WHERE n <= 3""")
def cell_examples(spark: SparkSession, d: str) -> DataFrame:
    """Rows are numbered by their keys, which are theirs already; at most three examples each are the feature."""
    numbered = visits(spark, d).withColumn("_row", F.col("visit")).drop("visit")
    return columns.cell_evidence(columns.cells(numbered, set(), 10_000)).drop("reason")


@query("""SELECT replace(replace(replace(p_brand || '/' || p_type, '#', '%23'), '/', '%2F'), ' ', '%20') AS location, 'inaccessible' AS status, 'requested_table_not_discovered' AS reason FROM part GROUP BY p_brand, p_type HAVING min(p_size) >= 10""")
def requested_tables_missing(spark: SparkSession, d: str) -> DataFrame:
    """Every brand and type of a part is asked for; those with a small part are there."""
    tables = t(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_type").alias("table"), "p_size")
    return columns.missing_tables(tables, tables.where("p_size < 10"))


@query("""WITH p AS (SELECT 'part' || p_partkey AS name, p_partkey AS k, p_size, row_number() OVER (ORDER BY 'part' || p_partkey) AS n FROM part)
SELECT name AS location, CASE WHEN p_size % 5 = 0 THEN 'excluded' WHEN p_size % 3 = 0 THEN 'unsupported' WHEN k % 7 = 0 THEN 'failed' END AS status,
CASE WHEN p_size % 5 = 0 THEN 'database_views_not_scanned' WHEN p_size % 3 = 0 THEN 'mysql_storage_engine_not_supported' WHEN k % 7 = 0 THEN 'table_query_or_detection_failed' END AS reason FROM p WHERE n <= 1000
UNION ALL SELECT '[inventory]', 'partial', 'database_table_inventory_limit' FROM p WHERE n = 1001""")
def table_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Parts as tables of a database: views, other engines, and tables that the account may write. The feature itself
    stops after 1,000 names, with a row that says so."""
    p = t(spark, d, "part").withColumn("table", F.concat(F.lit("part"), "p_partkey"))
    found = p.select("table", F.when(F.col("p_size") % 5 == 0, "VIEW").otherwise("BASE TABLE").alias("type"), F.when(F.col("p_size") % 3 == 0, "MyISAM").otherwise("InnoDB").alias("engine"))
    may = p.select("table", F.explode(F.array(F.lit("select"), F.when(F.col("p_partkey") % 7 == 0, "DELETE").otherwise("SHOW VIEW"))).alias("privilege"))
    return inventory.judged(found, "mysql", grants=may).drop("table")


@query("SELECT count(*) AS n, count(*) FILTER (CAST(c_acctbal AS VARCHAR) <> '') AS filled FROM customer")
def full_table_scan(spark: SparkSession, d: str) -> DataFrame:
    coverage, _ = columns.scan_table(t(spark, d, "customer"), "customer", Options(full_scan=True), fingerprint=False)
    return coverage.where("column = 'c_acctbal'").select(F.col("examined").alias("n"), F.col("nonempty").alias("filled"))


# The catalogue.

OBJECTS_SQL = """(SELECT doc_id AS object_key, 'doc/' || doc_id AS location, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN length(text) > 2000 THEN 'partial' ELSE 'full' END AS status,
CASE WHEN doc_id % 2 = 0 THEN 's1' ELSE 's2' END AS scan_id FROM documents)"""
FOUND_SQL = f"""(SELECT doc_id AS finding_id, doc_id AS object_key, CASE WHEN doc_id % 2 = 0 THEN 's1' ELSE 's2' END AS scan_id, kind AS entity_type, 'personal_data' AS classification, n AS match_count,
CASE WHEN doc_id % 3 = 0 THEN 'confirmed' ELSE 'needs_review' END AS review_status FROM {DETECTED_SQL})"""
SCANS_SQL = "(VALUES ('s1', 'a', 'v1', 'main'), ('s2', 'b', 'v2', 'other')) AS c(scan_id, source_id, detector_version, source_name)"


def catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = t(spark, d, "documents")
    which = lambda k: F.when(k % 2 == 0, "s1").otherwise("s2").alias("scan_id")
    status = F.when(F.col("doc_id") % 7 == 0, "failed").otherwise(bounded(F.col("text"), 2_000)[1])
    objects = docs.select(F.col("doc_id").alias("object_key"), F.concat(F.lit("doc/"), "doc_id").alias("location"), status.alias("status"), which(F.col("doc_id")))
    found = findings.detect(docs, "doc_id", "text")
    found = found.select(F.col("object").alias("finding_id"), F.col("object").alias("object_key"), which(F.col("object")), "entity_type", "classification", "match_count", F.when(F.col("object") % 3 == 0, "confirmed").otherwise("needs_review").alias("review_status"))
    scans = spark.createDataFrame([("s1", "a", "v1"), ("s2", "b", "v2")], "scan_id string, source_id string, detector_version string")
    return objects, found, scans, spark.createDataFrame([("a", "main"), ("b", "other")], "source_id string, name string")


@query(f"SELECT status, count(*) AS n, count(*) * 100 / (SELECT count(*) FROM documents)::DOUBLE AS percent, status <> 'full' AS gap FROM {OBJECTS_SQL} GROUP BY status")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.coverage(catalogue(spark, d)[0])


@query(f"SELECT scan_id, status, count(*) AS n FROM {OBJECTS_SQL} GROUP BY ROLLUP (scan_id, status)")
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.coverage_rollup(catalogue(spark, d)[0], "scan_id", "status")


@query(f"SELECT 2::BIGINT AS sources, 2::BIGINT AS scans, (SELECT count(*) FROM {OBJECTS_SQL}) AS objects, (SELECT count(*) FROM {FOUND_SQL}) AS findings, (SELECT count(*) FROM {OBJECTS_SQL} WHERE status <> 'full') AS gaps")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    objects, found, scans, sources = catalogue(spark, d)
    return catalog.overview(sources, scans, objects, found)


LISTED_SQL = f"SELECT f.finding_id, f.scan_id, f.object_key, f.entity_type, f.classification, f.match_count, f.review_status, o.location, o.status AS coverage_status, c.source_id, c.detector_version, c.source_name FROM {FOUND_SQL} f JOIN {OBJECTS_SQL} o USING (object_key) JOIN {SCANS_SQL} ON c.scan_id = f.scan_id"


@query(f"SELECT * FROM ({LISTED_SQL}) WHERE review_status = 'needs_review' AND scan_id = 's1'")
def findings_listing(spark: SparkSession, d: str) -> DataFrame:
    objects, found, scans, sources = catalogue(spark, d)
    return catalog.listing(found, objects, scans, sources, scan_id="s1", review="needs_review")


@query(f"SELECT * FROM ({LISTED_SQL}) WHERE contains(lower(location || ' ' || entity_type || ' ' || classification), 'doc/1')")
def findings_search(spark: SparkSession, d: str) -> DataFrame:
    objects, found, scans, sources = catalogue(spark, d)
    return catalog.search(catalog.listing(found, objects, scans, sources), "DOC/1")


@query(f"SELECT o.object_key, o.status, count(f.finding_id)::BIGINT AS findings FROM {OBJECTS_SQL} o LEFT JOIN {FOUND_SQL} f USING (object_key) GROUP BY ALL")
def object_finding_counts(spark: SparkSession, d: str) -> DataFrame:
    objects, found, _, _ = catalogue(spark, d)
    return catalog.finding_counts(objects.select("object_key", "status"), found, "object_key")


@query("""SELECT c_custkey, CASE WHEN regexp_matches(v, '^ *[=+@-]') THEN '''' || v ELSE v END AS cell FROM
(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '=1+' || c_name WHEN 1 THEN ' +' || c_name WHEN 2 THEN '-' || c_name WHEN 3 THEN '@' || c_name WHEN 4 THEN c_name ELSE 'None' END AS v FROM customer)""")
def export_csv_guard(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("c_custkey") % 6, F.col("c_name")
    value = F.when(k == 0, F.concat(F.lit("=1+"), name)).when(k == 1, F.concat(F.lit(" +"), name)).when(k == 2, F.concat(F.lit("-"), name)).when(k == 3, F.concat(F.lit("@"), name)).when(k == 4, name)
    return t(spark, d, "customer").select("c_custkey", csv_guard(value).alias("cell"))


@query(f"SELECT finding_id, CASE WHEN finding_id % 4 = 0 THEN 'false_positive' ELSE review_status END AS review_status FROM {FOUND_SQL}")
def reviews_applied(spark: SparkSession, d: str) -> DataFrame:
    found = catalogue(spark, d)[1]
    twice = found.where("finding_id % 4 = 0").select("finding_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("confirmed").alias("s")), F.struct(F.lit(2).alias("at"), F.lit("false_positive").alias("s")))).alias("x"))
    return catalog.reviewed(found, twice.select("finding_id", F.col("x.at").alias("at"), F.col("x.s").alias("review_status"))).select("finding_id", "review_status")


# Comparison of scans.

SIDE_SQL = """(SELECT o_orderkey AS object_key, CASE o_orderkey % {m} WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' WHEN 2 THEN 'sampled' ELSE 'full' END AS status, (100 - o_orderkey % {e})::BIGINT AS examined, (o_custkey % {f})::VARCHAR AS fingerprint FROM orders WHERE o_orderkey % 23 <> {out})"""
OLD_SQL, NEW_SQL = SIDE_SQL.format(m=11, e=3, f=1, out=1), SIDE_SQL.format(m=13, e=4, f=1, out=2)
FLAGS_SQL = "(SELECT l_orderkey AS object_key, l_returnflag AS entity_type, 'personal_data' AS classification, CASE WHEN l_linestatus = 'O' THEN 'open' END AS reason, 'column' AS segment, count(*)::BIGINT AS count FROM lineitem WHERE {w} GROUP BY ALL)"
OLD_F, NEW_F = FLAGS_SQL.format(w="l_linenumber <= 3 AND l_orderkey % 23 <> 1"), FLAGS_SQL.format(w="l_linenumber <= 3 + (l_orderkey % 5 = 0)::INT AND l_orderkey % 7 <> 0 AND l_orderkey % 23 <> 2")
CHANGES_SQL = f"""
WITH a AS {OLD_SQL}, b AS {NEW_SQL}, af AS (SELECT object_key, list_sort(list((entity_type, coalesce(reason, '-'), count))) AS m FROM {OLD_F} GROUP BY 1), bf AS (SELECT object_key, list_sort(list((entity_type, coalesce(reason, '-'), count))) AS m FROM {NEW_F} GROUP BY 1)
SELECT coalesce(a.object_key, b.object_key) AS object_key, CASE
  WHEN b.object_key IS NULL THEN 'coverage_lost'
  WHEN a.object_key IS NOT NULL AND a.status = b.status AND a.status IN ('partial','failed') THEN 'not_comparable'
  WHEN b.status IN ('partial','failed') OR (a.status = 'full' AND b.status <> 'full') OR (b.examined < a.examined AND b.status <> 'full') THEN 'coverage_lost'
  WHEN a.status IN ('partial','failed') THEN 'not_comparable'
  WHEN a.object_key IS NULL THEN 'new'
  WHEN af.m IS NOT NULL AND bf.m IS NULL THEN CASE WHEN a.status = 'full' AND b.status = 'full' THEN 'no_longer_observed' ELSE 'not_comparable' END
  WHEN af.m IS DISTINCT FROM bf.m OR a.fingerprint IS DISTINCT FROM b.fingerprint THEN 'changed' ELSE 'unchanged' END AS change,
  a.status AS before_status, b.status AS after_status
FROM a FULL OUTER JOIN b ON a.object_key = b.object_key LEFT JOIN af ON af.object_key = a.object_key LEFT JOIN bf ON bf.object_key = b.object_key"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem")
    k = F.col("o_orderkey")

    def side(m: int, e: int, out: int) -> DataFrame:
        status = F.when(k % m == 0, "partial").when(k % m == 1, "failed").when(k % m == 2, "sampled").otherwise("full")
        return orders.where(k % 23 != out).select(k.alias("object_key"), status.alias("status"), (100 - k % e).alias("examined"), F.lit("0").alias("fingerprint"))

    def flags(w: str) -> DataFrame:
        return lines.where(w).select(F.col("l_orderkey").alias("object_key"), F.col("l_returnflag").alias("entity_type"), F.lit("personal_data").alias("classification"), F.when(F.col("l_linestatus") == "O", "open").alias("reason"), F.lit("column").alias("segment"), F.lit(1).alias("match_count"))

    return side(11, 3, 1), side(13, 4, 2), flags("l_linenumber <= 3 AND l_orderkey % 23 <> 1"), flags("l_linenumber <= 3 + CAST(l_orderkey % 5 = 0 AS INT) AND l_orderkey % 7 <> 0 AND l_orderkey % 23 <> 2")


@query(CHANGES_SQL)
def compare_object_changes(spark: SparkSession, d: str) -> DataFrame:
    return compare.object_changes(*snapshots(spark, d))


@query(f"SELECT change, count(*) AS n FROM ({CHANGES_SQL}) GROUP BY 1")
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return compare.summary(compare.object_changes(*snapshots(spark, d)))


@query(f"""
WITH a AS {OLD_SQL}, b AS {NEW_SQL}, af AS {OLD_F}, bf AS {NEW_F}, ok AS (SELECT b.object_key FROM b JOIN a USING (object_key) WHERE b.status = 'full' AND a.status = 'full')
SELECT object_key, entity_type, classification, reason, segment, before_count, after_count, CASE WHEN before_count = 0 THEN 'new' WHEN after_count = 0 THEN 'no_longer_observed' WHEN before_count <> after_count THEN 'changed' ELSE 'unchanged' END AS change FROM
(SELECT object_key, entity_type, classification, reason, segment, sum(x)::BIGINT AS before_count, sum(y)::BIGINT AS after_count FROM (SELECT * EXCLUDE (count), count AS x, 0 AS y FROM af UNION ALL SELECT * EXCLUDE (count), 0, count FROM bf) GROUP BY ALL) WHERE object_key IN (SELECT object_key FROM ok)""")
def compare_finding_deltas(spark: SparkSession, d: str) -> DataFrame:
    return compare.finding_deltas(*snapshots(spark, d))


# Evaluation.


@query("""
WITH g AS (SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1), f AS (SELECT doc_id, 'quality' AS label FROM labels WHERE doc_id % 5 <> 0 UNION SELECT doc_id, 'toxic' FROM labels WHERE doc_id % 4 = 0),
e AS (SELECT p.label, g.doc_id IS NOT NULL AS g, f.doc_id IS NOT NULL AS f FROM (SELECT doc_id, l AS label FROM labels, (VALUES ('quality'), ('toxic'), ('unseen')) v(l)) p LEFT JOIN g USING (doc_id, label) LEFT JOIN f USING (doc_id, label)),
c AS (SELECT label, count(*) FILTER (g AND f) AS tp, count(*) FILTER (NOT g AND f) AS fp, count(*) FILTER (g AND NOT f) AS fn, count(*) FILTER (NOT g AND NOT f) AS tn FROM e GROUP BY 1),
r AS (SELECT *, true AS complete, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN tp + fn < 30 OR fp + tn < 30 THEN 'unvalidated' WHEN coalesce(precision >= 0.95 AND recall >= 0.95, false) THEN 'target_met' ELSE 'below_target' END AS verdict FROM r""")
def eval_object_presence(spark: SparkSession, d: str) -> DataFrame:
    labels = t(spark, d, "labels")
    pairs = lambda q, x: labels.where(q).select(F.col("doc_id").alias("object"), F.lit("quality").alias("label")).unionByName(labels.where(x).select(F.col("doc_id").alias("object"), F.lit("toxic").alias("label")))
    objects = labels.select(F.col("doc_id").alias("object"), F.lit("full").alias("status"))
    return evaluate.presence_metrics(pairs("quality = 1", "toxic = 1"), pairs("doc_id % 5 <> 0", "doc_id % 4 = 0"), objects, spark.createDataFrame([("quality",), ("toxic",), ("unseen",)], "label string"))


@query("""
WITH g AS (SELECT l_orderkey AS o, l_returnflag AS label, l_linestatus AS v, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL), s AS (SELECT l_orderkey AS o, l_returnflag AS label, l_linestatus AS v, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL),
b AS (SELECT label, coalesce(g.n, 0) AS g, coalesce(s.n, 0) AS s FROM g FULL OUTER JOIN s USING (o, label, v)), c AS (SELECT label, sum(least(g, s))::BIGINT AS tp, sum(s - least(g, s))::BIGINT AS fp, sum(g - least(g, s))::BIGINT AS fn FROM b GROUP BY 1)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c""")
def eval_occurrences(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("object"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("value"), "l_linenumber")
    return evaluate.occurrence_metrics(lines.where("l_linenumber < 4"), lines.where("l_linenumber > 1"))


@query("""
WITH g AS (SELECT DISTINCT o_orderkey AS r, o_custkey AS x FROM orders WHERE o_orderkey % 10 <> 0), s AS (SELECT DISTINCT o_orderkey AS r, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS x FROM orders WHERE o_orderkey % 9 <> 0),
c AS (SELECT count(*) FILTER (g.r IS NOT NULL AND s.r IS NOT NULL) AS tp, count(*) FILTER (g.r IS NULL) AS fp, count(*) FILTER (s.r IS NULL) AS fn FROM g FULL OUTER JOIN s ON g.r = s.r AND g.x = s.x) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c""")
def eval_associations(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return evaluate.association_metrics(o.where(k % 10 != 0).select(k.alias("record"), c.alias("reference")), o.where(k % 9 != 0).select(k.alias("record"), F.when(k % 7 == 0, c + 1).otherwise(c).alias("reference")))


@query("SELECT 'content_hash' AS kind, h AS value FROM (SELECT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return evaluate.leakage(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"))


@query("SELECT sha256(text) AS fingerprint, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_objects(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.duplicates(t(spark, d, "documents").select(F.sha2("text", 256).alias("fingerprint")), "fingerprint")


# Retention and time.


@query("SELECT o_orderkey AS scan_id FROM orders WHERE o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def retention_expired(spark: SparkSession, d: str) -> DataFrame:
    scans = t(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("created_at"))
    return retention.purge(scans, F.lit("1996-01-01").cast("timestamp"))[0].select("scan_id")


@query("SELECT count(*) FILTER (o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01') AS expired, count(*) FILTER (o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01') > 100 AS backlog FROM orders")
def retention_backlog(spark: SparkSession, d: str) -> DataFrame:
    return retention.backlog(t(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("created_at")), F.lit("1996-01-01").cast("timestamp"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) <= 5 AS allowed FROM events")
def sliding_attempts(spark: SparkSession, d: str) -> DataFrame:
    return retention.attempts_allowed(t(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"))).select("event_id", "allowed")


@query("""SELECT event_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM
(SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def event_runs(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events")
    gap = F.col("ts") - F.lag("ts").over(spatial.ordered(["user_id"], ["ts", "event_id"])) >= F.make_dt_interval(F.lit(0), F.lit(1))
    return spatial.islands(events, ["user_id"], ["ts", "event_id"], gap).select("event_id", "run")


# Boxes, spans and graphs.

BOX_SQL = "(SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, l_suppkey AS page, (l_partkey % 97) / 100.0::DOUBLE AS \"left\", (l_quantity * 13 % 89) / 100.0::DOUBLE AS top, least(1.0, (l_partkey % 97) / 100.0::DOUBLE + 0.04) AS \"right\", least(1.0, (l_quantity * 13 % 89) / 100.0::DOUBLE + 0.02) AS bottom FROM lineitem)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    left, top = (F.col("l_partkey") % 97) / 100.0, (F.col("l_quantity") * 13 % 89) / 100.0
    return t(spark, d, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("id"), F.col("l_suppkey").alias("page"), left.alias("left"), top.alias("top"), F.least(F.lit(1.0), left + 0.04).alias("right"), F.least(F.lit(1.0), top + 0.02).alias("bottom"))


@query(f"""SELECT a.page, a.id AS a, b.id AS b FROM {BOX_SQL} a JOIN {BOX_SQL} b ON a.page = b.page AND a.id < b.id AND a."left" < b."right" AND b."left" < a."right" AND a.top < b.bottom AND b.top < a.bottom""")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return spatial.overlapping(b, b, "page", same=True).select("page", "a", "b")


@query(f"""WITH w AS (SELECT row_number() OVER () AS k, * FROM {BOX_SQL}), r AS (SELECT p.page, q.id, q.x / 4.0 AS l, (q.x + 1) / 4.0 AS r FROM (SELECT DISTINCT page FROM w) p, (VALUES (1, 0), (2, 1), (3, 2)) q(id, x)),
m AS (SELECT w.k, w.page, w.id AS word, count(r.id) AS n, min(r.id) AS rectangle FROM w LEFT JOIN r ON r.page = w.page AND (w."left" + w."right") / 2 BETWEEN r.l AND r.r GROUP BY ALL) SELECT page, word, CASE WHEN n = 1 THEN rectangle END AS rectangle FROM m""")
def rectangle_owners(spark: SparkSession, d: str) -> DataFrame:
    w = boxes(spark, d)
    gold = w.select("page").distinct().withColumn("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("page", "id", ((F.col("id") - 1) / 4.0).alias("left"), F.lit(0.0).alias("top"), (F.col("id") / 4.0).alias("right"), F.lit(1.0).alias("bottom"))
    return spatial.owners(w, gold, "page")


@query(f"SELECT page, min(\"left\") AS \"left\", min(top) AS top, max(\"right\") AS \"right\", max(bottom) AS bottom, round(median(bottom - top), 9) AS height FROM {BOX_SQL} GROUP BY page")
def page_bounds(spark: SparkSession, d: str) -> DataFrame:
    return spatial.bounds(boxes(spark, d), "page").withColumn("height", F.round("height", 9))


@query("SELECT o_custkey, o_orderkey AS id, o_orderkey % 1000 AS at, CASE WHEN o_orderkey % 100 < 60 THEN 'span' || ((o_orderkey % 1000) // 100) END AS name FROM orders")
def spans_containing(spark: SparkSession, d: str) -> DataFrame:
    """Points in spans [100 i, 100 i + 60) of each customer."""
    o = t(spark, d, "orders")
    points = o.select("o_custkey", (F.col("o_orderkey") % 1000).alias("at"), F.col("o_orderkey").alias("id"))
    spans = o.select("o_custkey").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("o_custkey", (F.col("i") * 100).cast("long").alias("start"), (F.col("i") * 100 + 60).cast("long").alias("end"), F.concat(F.lit("span"), "i").alias("name"))
    return spatial.containing(points, spans, "o_custkey")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 7 AS b FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey + 7 <= (SELECT max(c_custkey) FROM customer)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT c_custkey AS id, c_custkey AS x FROM customer UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.x) SELECT id, min(x) AS component FROM r GROUP BY id""")
def line_components(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    edges = c.where("id % 5 <> 0").select(F.col("id").alias("a"), (F.col("id") + 7).alias("b")).join(c.select(F.col("id").alias("b")), "b", "left_semi")
    return graph.components(edges, c)


# Pages of words.


def page_words(spark: SparkSession, d: str) -> DataFrame:
    """A page for each customer: a patient's field, a diagnosis right below it or far below, and a doctor's line."""
    k = F.col("c_custkey")
    line = lambda text, top, n: F.struct(F.split(text, " ").alias("w"), F.lit(top).cast("double").alias("top"), F.lit(n).alias("line"))
    far = F.when(k % 2 == 0, line(F.lit("Diagnosis: diabetes"), 0.13, 2)).otherwise(line(F.lit("Diagnosis: diabetes"), 0.5, 2))
    rows = t(spark, d, "customer").select(k.alias("page"), F.explode(F.array(line(F.concat(F.lit("MRN: C000"), k), 0.1, 1), far, line(F.lit("Dr. Somebody"), 0.8, 3))).alias("l"))
    each = rows.select("page", "l.top", "l.line", F.posexplode("l.w").alias("i", "text"))
    left = 0.1 + F.col("i") * 0.12
    return each.select("page", "text", left.alias("left"), "top", (left + 0.1).alias("right"), (F.col("top") + 0.02).alias("bottom"), F.lit(1).alias("block"), "line", (F.col("line") * 10 + F.col("i")).alias("ordinal"))


@query("""
SELECT c_custkey AS page, 0 AS region, 'record' AS kind, 'explicit_patient_field' AS reason, 'MRN: C000' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Diagnosis: diabetes' ELSE '' END AS text FROM customer
UNION ALL SELECT c_custkey, 1, 'residual', 'unlabelled_content', 'Diagnosis: diabetes' FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 1 + c_custkey % 2, 'residual', 'nonpatient_section', 'Dr. Somebody' FROM customer""")
def layout_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_regions(page_words(spark, d), ["page"]).select("page", "region", "kind", "reason", "text")


@query("""
SELECT c_custkey AS page, 'MRN' AS entity_type, 'personal_data' AS classification, 1::BIGINT AS match_count, 'region:1/record' AS segment FROM customer
UNION ALL SELECT c_custkey, 'HEALTH_INFORMATION', CASE WHEN c_custkey % 2 = 0 THEN 'patient_linked_health' ELSE 'clinical_content' END, 2, CASE WHEN c_custkey % 2 = 0 THEN 'region:1/record' ELSE 'region:2/segment:1/block:1/row:1' END FROM customer""")
def layout_findings(spark: SparkSession, d: str) -> DataFrame:
    return layout.document_findings(page_words(spark, d), ["page"]).select("page", "entity_type", "classification", "match_count", "segment")


def two_channels(spark: SparkSession, d: str) -> DataFrame:
    """The second channel repeats the first, but for one word on every other page."""
    w = page_words(spark, d)
    read = w.withColumn("text", F.when((F.col("page") % 2 == 1) & (F.col("text") == "diabetes"), "cancer").otherwise(F.col("text")))
    return w.withColumn("channel", F.lit("native")).unionByName(read.withColumn("channel", F.lit("ocr")))


NATIVE_SQL = "'MRN: C000' || c_custkey || chr(10) || 'Diagnosis: diabetes' || chr(10) || 'Dr. Somebody'"
BOTH_SQL = f"{NATIVE_SQL} || CASE WHEN c_custkey % 2 = 1 THEN chr(10) || chr(10) || 'Diagnosis: cancer' ELSE '' END"


@query(f"SELECT c_custkey AS page, {BOTH_SQL} AS text, CASE WHEN c_custkey % 2 = 1 THEN 2 ELSE 3 END::BIGINT AS suppressed, (c_custkey % 2)::BIGINT AS conflicts FROM customer")
def channel_texts(spark: SparkSession, d: str) -> DataFrame:
    return channels.page_texts(two_channels(spark, d), ["page"]).select("page", "text", "suppressed", "conflicts")


@query(f"SELECT c_custkey AS page, 'native' AS channel, 1 AS fragment, {NATIVE_SQL} AS text FROM customer UNION ALL SELECT c_custkey, 'ocr', 1, 'Diagnosis: cancer' FROM customer WHERE c_custkey % 2 = 1")
def channel_fragments(spark: SparkSession, d: str) -> DataFrame:
    return channels.fragments(channels.reconciled(two_channels(spark, d), ["page"]), ["page"])


DOCUMENT_SQL = f"(SELECT c_custkey AS doc, {NATIVE_SQL} AS native, CASE c_custkey % 4 WHEN 1 THEN {BOTH_SQL} || chr(12) || 'found elsewhere' WHEN 2 THEN 'other ' || {BOTH_SQL} ELSE {BOTH_SQL} END AS text FROM customer)"


def customer_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A document of one page for each customer: as its channels say, with a supplement, with other text, or cut off."""
    k = F.col("c_custkey")
    native = F.concat(F.lit("MRN: C000"), k, F.lit("\nDiagnosis: diabetes\nDr. Somebody"))
    both = F.concat(native, F.when(k % 2 == 1, "\n\nDiagnosis: cancer").otherwise(""))
    text = F.when(k % 4 == 1, F.concat(both, F.lit("\ffound elsewhere"))).when(k % 4 == 2, F.concat(F.lit("other "), both)).otherwise(both)
    c = t(spark, d, "customer")
    documents = c.select(k.alias("doc"), text.alias("text"), (k % 4 == 3).alias("truncated"))
    whole = k % 5 != 0
    units = c.select(k.alias("doc"), F.lit(1).alias("unit"), F.lit("pdf").alias("kind"), whole.alias("eligible"), F.when(whole, channels.VERIFIED).otherwise(channels.INCOMPLETE).alias("reason"), F.lit(True).alias("processed"), native.alias("native_text"), native.alias("text"))
    words = two_channels(spark, d).select(F.col("page").alias("doc"), F.lit(1).alias("unit"), "channel", "ordinal", "text", "left", "top", "right", "bottom", "block", "line")
    return documents, units, words


@query(f"SELECT doc, CASE doc % 4 WHEN 0 THEN '' WHEN 1 THEN 'found elsewhere' ELSE text END AS residual, doc % 4 >= 2 AS fallback, CASE doc % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'unmapped_supplement' WHEN 2 THEN 'document_text_alignment_unverified' ELSE 'document_text_truncated' END AS reason FROM {DOCUMENT_SQL}")
def document_residuals(spark: SparkSession, d: str) -> DataFrame:
    return channels.document_channels(*customer_documents(spark, d))[2]


@query(f"""SELECT doc, 1 AS unit, 'native' AS channel, 0::BIGINT AS "start", length(native)::BIGINT AS "end", doc % 5 <> 0 AND doc % 2 = 0 AS eligible, CASE WHEN doc % 5 = 0 THEN 'document_inventory_incomplete' WHEN doc % 2 = 0 THEN 'verified' ELSE 'native_ocr_overlap_unresolved' END AS reason FROM {DOCUMENT_SQL} WHERE doc % 4 < 2
UNION ALL SELECT doc, 1, 'ocr', length(native) + 2, length(native) + 19, FALSE, CASE WHEN doc % 5 = 0 THEN 'document_inventory_incomplete' ELSE 'native_ocr_overlap_unresolved' END FROM {DOCUMENT_SQL} WHERE doc % 4 = 1""")
def document_channels(spark: SparkSession, d: str) -> DataFrame:
    return channels.document_channels(*customer_documents(spark, d))[0].select("doc", "unit", "channel", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "eligible", "reason")


@query(f"""WITH d AS {DOCUMENT_SQL}, e AS (SELECT * FROM d WHERE doc % 4 = 0 AND doc % 5 <> 0)
SELECT doc, 'page:1/channel:native/region:1' AS prefix, left(native, length(native) - 13) AS text, TRUE AS candidate FROM e UNION ALL SELECT doc, 'page:1/channel:native/region:2', 'Dr. Somebody', FALSE FROM e
UNION ALL SELECT doc, 'page:1/channel:native/region:1', native, FALSE FROM d WHERE doc % 4 < 2 AND doc NOT IN (SELECT doc FROM e) UNION ALL SELECT doc, 'page:1/channel:ocr/region:1', 'Diagnosis: cancer', FALSE FROM d WHERE doc % 4 = 1
UNION ALL SELECT doc, 'document:unmapped/channel:unmapped/region:1', CASE WHEN doc % 4 = 1 THEN 'found elsewhere' ELSE text END, FALSE FROM d WHERE doc % 4 > 0""")
def document_plan(spark: SparkSession, d: str) -> DataFrame:
    return channels.document_regions(*customer_documents(spark, d)).drop("words")


@query("""SELECT c_custkey AS doc, 'MRN' AS entity_type, 'personal_data' AS classification, 1::BIGINT AS match_count FROM customer
UNION ALL SELECT c_custkey, 'HEALTH_INFORMATION', CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN 'patient_linked_health' ELSE 'clinical_content' END, 2 + 2 * (c_custkey % 2) FROM customer""")
def document_plan_findings(spark: SparkSession, d: str) -> DataFrame:
    found = channels.plan_findings(channels.document_regions(*customer_documents(spark, d)))
    return found.groupBy("doc", "entity_type", "classification").agg(F.sum("match_count").alias("match_count"))


@query("SELECT c_custkey AS page, 0 AS ordinal, 0::BIGINT AS times FROM customer WHERE c_custkey % 3 = 0")
def words_lost(spark: SparkSession, d: str) -> DataFrame:
    """Regions of every page hold each word once; then the first record of every third page is taken away, with the word
    that only it holds."""
    w = page_words(spark, d)
    found = layout.page_regions(w, ["page"]).select("page", F.when(F.col("page") % 3 == 0, F.array_remove("words", 0)).otherwise(F.col("words")).alias("words"))
    return channels.lost_words(found, w.select("page", F.row_number().over(Window.partitionBy("page").orderBy("ordinal")).alias("n")).select("page", (F.col("n") - 1).alias("ordinal")), ["page"])


# Accounts of page readers, and pages of two readers.


def frame_accounts(spark: SparkSession, d: str) -> DataFrame:
    """An account for each customer, a frame for each order. Every seventh order can't be rendered, every eleventh is cut
    off; every 13th customer claims the opposite, every 17th miscounts, every 19th gives a reason of its own."""
    k, doc = F.col("o_orderkey"), F.col("doc")
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(k)).alias("ordinal"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Order "), k)).alias("text"), (k % 7 == 0).alias("lost"), (k % 11 == 0).alias("cut"))
    status = lambda other: F.when(F.col("lost"), other).otherwise("completed")
    unit = F.struct("ordinal", status("failed").alias("render_status"), status("not_attempted").alias("ocr_status"), "text", (F.col("cut") & ~F.col("lost")).alias("truncated"))
    g = o.groupBy("doc").agg(F.array_sort(F.collect_list(unit)).alias("units"), F.count_if(~F.col("lost") & ~F.col("cut")).alias("read"), F.sum(F.char_length("text")).alias("n_chars"))
    complete = (F.col("read") == F.size("units")) & (doc % 19 != 0)
    account = F.struct(
        F.lit(accounts.PROTOCOL).alias("protocol"), F.lit("image").alias("kind"), F.size("units").alias("original_unit_count"), F.lit(0).alias("units_omitted"), (complete != (doc % 13 == 0)).alias("page_accounting_complete"), F.lit(False).alias("limited"),
        F.lit(False).alias("legibility_verified"), F.when(doc % 19 == 0, F.array(F.lit("odd"), F.lit("page_limit"), F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"), (doc % 3 == 0).alias("nonvisual_content_present"),
        (F.col("n_chars") + F.when(doc % 17 == 0, 1).otherwise(0)).alias("text_characters"), "units",
    )
    return g.select("doc", F.lit("image").alias("kind"), F.to_json(account).alias("report"))


FRAMES_SQL = """(SELECT *, n > 100 OR doc % 17 = 0 AS wrong, read = n AND doc % 19 <> 0 AS done FROM (SELECT o_custkey AS doc, count(*) AS n, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS read,
string_agg(CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Order ' || o_orderkey END, chr(12) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1))"""


@query(f"""SELECT doc, CASE WHEN f IS NOT NULL THEN 'failed' WHEN done AND doc % 3 <> 0 THEN 'full' ELSE 'partial' END AS status,
CASE WHEN f IS NOT NULL THEN 'page_ocr_unavailable_or_invalid_response' WHEN NOT done THEN 'page_or_frame_ocr_incomplete' WHEN doc % 3 = 0 THEN 'image_nonvisual_metadata_not_inspected' END AS reason, f AS fault,
CASE WHEN f IS NULL THEN text END AS text, CASE WHEN f IS NULL THEN read ELSE 0 END AS examined, CASE WHEN f IS NULL THEN CASE WHEN doc % 19 = 0 THEN 'page_limit,worker_reported_incomplete' ELSE '' END END AS reasons
FROM (SELECT *, CASE WHEN wrong THEN 'invalid_accounting' WHEN doc % 13 = 0 THEN 'inconsistent_accounting' END AS f FROM {FRAMES_SQL})""")
def ocr_accounts(spark: SparkSession, d: str) -> DataFrame:
    told = accounts.accounted(frame_accounts(spark, d)).documents
    return told.select("doc", "status", "reason", "fault", "text", "examined", F.array_join("reasons", ",").alias("reasons"))


@query(f"""SELECT doc, n <= 100 AS valid, CASE WHEN n <= 100 THEN n END AS total, CASE WHEN n <= 100 THEN read END AS completed, CASE WHEN n <= 100 THEN 0 END::BIGINT AS omitted,
CASE WHEN n <= 100 THEN done <> (doc % 13 = 0) AND read = n END AS complete, CASE WHEN n <= 100 THEN doc % 3 = 0 END AS uninspected FROM {FRAMES_SQL}""")
def ocr_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of the accounts as they stand: counts of units are made anew, sums of characters aren't looked at."""
    shown = frame_accounts(spark, d).select("doc", accounts.coverage_view(F.col("report")).alias("v"))
    return shown.select("doc", "v.valid", "v.total", "v.completed", "v.omitted", "v.complete", "v.uninspected")


def page_accounts(spark: SparkSession, d: str) -> DataFrame:
    """A page for each customer with both channels. Every fourth has no verified places, every fifth no text of its own,
    every seventh a text that its words don't spell; two of three have an inventory of features."""
    k = F.col("page")
    w = two_channels(spark, d).where((F.col("channel") == "ocr") | (k % 5 != 0))
    lines = lambda rows: F.array_join(F.transform(rows, lambda x: x["text"]), " ")
    word = F.struct("ordinal", "text", "left", "top", "right", "bottom", "block", "line")
    side = lambda channel: F.array_sort(F.collect_list(F.when(F.col("channel") == channel, word)))
    g = w.groupBy("page").agg(side("native").alias("native_words"), side("ocr").alias("ocr_words"))
    g = g.withColumns({"native_text": lines("native_words"), "text": F.concat(lines("ocr_words"), F.when(k % 7 == 0, "!").otherwise(""))})
    verified = k % 4 != 0
    done = F.lit("completed")
    unit = F.struct(
        F.lit(1).alias("ordinal"), done.alias("render_status"), done.alias("ocr_status"), "text", F.lit(False).alias("truncated"), done.alias("native_status"), "native_text", F.lit(False).alias("native_text_truncated"), verified.alias("geometry_verified"),
        F.when(verified, "verified").otherwise("mapping_unverified").alias("geometry_reason"), F.lit(1654).alias("pixel_width"), F.lit(2339).alias("pixel_height"), "ocr_words", "native_words",
    )
    counts = F.struct(*[(F.when(k % 5 != 0, 5).otherwise(0) if name == "native_text_operations" else F.lit(0)).alias(name) for name in accounts.FEATURES])
    inventory = F.struct(
        F.lit(accounts.FEATURE_PROTOCOL).alias("protocol"), done.alias("status"), F.lit(True).alias("inventory_complete"), F.lit(True).alias("can_extract"), F.lit(True).alias("ancillary_absent"), F.lit(1).alias("original_page_count"),
        F.lit(False).alias("encrypted"), counts.alias("feature_counts"),
    )
    account = F.struct(
        F.lit(accounts.PROTOCOL).alias("protocol"), F.lit("pdf").alias("kind"), F.lit(1).alias("original_unit_count"), F.lit(0).alias("units_omitted"), F.lit(True).alias("page_accounting_complete"), F.lit(False).alias("limited"), F.lit(False).alias("legibility_verified"),
        F.array().cast("array<string>").alias("reason_codes"), (F.char_length("text") + F.char_length("native_text")).alias("text_characters"), F.array(unit).alias("units"), F.when(k % 3 != 0, inventory).alias("pdf_features"),
    )
    return g.select(k.alias("doc"), F.lit("pdf").alias("kind"), F.to_json(account).alias("report"))


SPELLED_SQL = "'MRN: C000' || c_custkey || ' Diagnosis: diabetes Dr. Somebody'"
PAGES_SQL = f"""(SELECT c_custkey AS doc, c_custkey % 2 = 1 AS odd, c_custkey % 4 <> 0 AS seen, c_custkey % 5 = 0 AS silent, c_custkey % 7 = 0 AS wrong, {NATIVE_SQL} AS native, {BOTH_SQL} AS twice, {SPELLED_SQL} AS spelled, c_custkey % 4 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 2 = 0) AS agreed FROM customer)"""


@query(f"""SELECT doc, CASE WHEN wrong THEN 'failed' WHEN agreed AND silent AND doc % 3 <> 0 THEN 'full' ELSE 'partial' END AS status,
CASE WHEN wrong THEN 'page_ocr_unavailable_or_invalid_response' WHEN agreed AND silent AND doc % 3 <> 0 THEN NULL WHEN agreed THEN 'pdf_native_representation_and_nonpage_coverage_unverified' ELSE 'pdf_native_ocr_overlap_unresolved' END AS reason,
CASE WHEN wrong THEN 'pdf_word_text_mismatch' END AS fault, CASE WHEN NOT wrong THEN CASE WHEN silent AND seen THEN CASE WHEN odd THEN replace(native, 'diabetes', 'cancer') ELSE native END WHEN silent THEN spelled WHEN seen THEN twice ELSE spelled || chr(10) || chr(10) || spelled END END AS text,
CASE WHEN NOT wrong THEN CASE WHEN silent OR NOT seen THEN 0 WHEN odd THEN 2 ELSE 3 END END::BIGINT AS suppressed, CASE WHEN NOT wrong THEN silent AND doc % 3 <> 0 END AS native_verified FROM {PAGES_SQL}""")
def pdf_accounts(spark: SparkSession, d: str) -> DataFrame:
    return accounts.accounted(page_accounts(spark, d)).documents.select("doc", "status", "reason", "fault", "text", "suppressed", "native_verified")


@query(f"SELECT doc, 1 AS unit, seen AS eligible, CASE WHEN seen THEN 'verified' ELSE 'mapping_unverified' END AS reason, CASE WHEN seen THEN CASE WHEN silent THEN 6 ELSE 12 END ELSE 0 END::BIGINT AS words FROM {PAGES_SQL} WHERE NOT wrong")
def pdf_units(spark: SparkSession, d: str) -> DataFrame:
    told = accounts.accounted(page_accounts(spark, d))
    n = told.words.groupBy("doc", "unit").agg(F.count("*").alias("words"))
    return told.units.join(n, ["doc", "unit"], "left").select("doc", "unit", "eligible", "reason", F.coalesce("words", F.lit(0).cast("long")).alias("words"))


def order_sheets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A document for each customer, a page for each order. By doc % 4, markup has the file's pages, has them backwards,
    lacks the last one, or has one more. Every fifth page reads otherwise in the file; every third document has text
    outside of its pages."""
    k, doc = F.col("o_orderkey"), F.col("doc")
    w = Window.partitionBy("o_custkey")
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(w.orderBy(k)).alias("unit"), F.count("*").over(w).alias("n"), F.concat(F.lit("Order "), k).alias("said"), (k % 5 == 0).alias("other"))
    native = o.select("doc", "unit", F.when(F.col("other"), F.concat("said", F.lit(" other"))).otherwise(F.col("said")).alias("native_text"))
    at = F.when(doc % 4 == 1, -F.col("unit")).otherwise(F.col("unit"))
    left = o.where((doc % 4 != 2) | (F.col("unit") < F.col("n"))).select("doc", at.alias("at"), "said")
    more = o.where("doc % 4 = 3 and unit = n").select("doc", (F.col("n") + 1).cast("int").alias("at"), F.lit("one more").alias("said"))
    page = F.concat(F.lit('<div class="page">'), "said", F.lit(" </div>"))
    g = left.unionByName(more).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", page.alias("p")))), lambda x: x["p"]), "").alias("body"))
    outside = F.when(doc % 3 == 0, "Form field").otherwise("")
    return g.select("doc", F.concat(F.lit("<html><head><title>t</title></head><body>"), "body", outside, F.lit("</body></html>")).alias("markup")), native


SHEETS_SQL = """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
b AS (SELECT doc, n AS ordinal, 'Order ' || k || CASE WHEN k % 5 = 0 THEN ' other' ELSE '' END AS b FROM o WHERE doc % 4 <> 2 OR m > 1),
a AS (SELECT doc, CASE WHEN doc % 4 = 1 THEN m + 1 - n ELSE n END AS ordinal, 'Order ' || k AS a, k % 5 <> 0 AS known FROM o WHERE doc % 4 <> 2 OR n < m UNION ALL SELECT doc, m + 1, 'one more', FALSE FROM o WHERE doc % 4 = 3 AND n = m),
p AS (SELECT doc, ordinal, CASE WHEN a IS NULL THEN 'missing' WHEN b IS NULL THEN 'surplus' WHEN a = b THEN 'equal' WHEN known THEN 'moved' ELSE 'differs' END AS state, a || ' ' AS text FROM a FULL JOIN b USING (doc, ordinal))"""


@query(f"{SHEETS_SQL} SELECT doc, ordinal::INTEGER AS ordinal, state, text FROM p")
def pdf_page_pairs(spark: SparkSession, d: str) -> DataFrame:
    markup, native = order_sheets(spark, d)
    return sheets.sheet_pairs(sheets.read_sheets(markup, "doc"), native.join(markup.select("doc"), "doc", "left_semi"), "doc")


@query(f"""{SHEETS_SQL} SELECT doc, CASE WHEN NOT mapped THEN rtrim(whole || CASE WHEN doc % 3 = 0 THEN 'Form field' ELSE '' END) ELSE concat_ws(chr(12), parts, CASE WHEN doc % 3 = 0 THEN 'Form field' END) END AS text, mapped,
CASE WHEN mapped THEN equal ELSE 0 END AS suppressed, CASE WHEN mapped THEN unmatched END AS unmatched, doc % 3 = 0 AS outside
FROM (SELECT doc, doc % 4 < 2 AS mapped, string_agg(text, chr(12) ORDER BY ordinal) AS whole, string_agg(text, chr(12) ORDER BY ordinal) FILTER (state IN ('differs', 'moved')) AS parts, count(*) FILTER (state = 'equal') AS equal, count(*) FILTER (state IN ('differs', 'moved')) AS unmatched FROM p GROUP BY 1)""")
def pdf_supplements(spark: SparkSession, d: str) -> DataFrame:
    return sheets.supplements(*order_sheets(spark, d))


# Words from what tools write about a page: a page for each customer, a line for each of its orders.

ORDER_LINES_SQL = "(SELECT o_custkey AS page, o_orderkey AS k, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS n FROM orders)"
WORDS_SQL = f"""SELECT page, (2 * (n - 1) + j)::INTEGER AS ordinal, CASE j WHEN 0 THEN 'Order' ELSE '#' || k END AS text, (10 + 100 * j) / 600.0::DOUBLE AS "left", (20 * n) / 4000.0::DOUBLE AS top, (70 + 100 * j) / 600.0::DOUBLE AS "right", (20 * n + 8) / 4000.0::DOUBLE AS bottom, 1 AS block, n AS line FROM {ORDER_LINES_SQL}, range(2) r(j)"""


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """(page, n, words) with the two words of each line: text, left, top, right, bottom in points."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = spread(t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey").select(F.col("o_custkey").alias("page"), n.alias("n"), F.concat(F.lit("#"), "o_orderkey").alias("k"))
    word = lambda text, left: F.struct(text.alias("text"), F.lit(left).alias("left"), (F.col("n") * 20).alias("top"), F.lit(left + 60).alias("right"), (F.col("n") * 20 + 8).alias("bottom"))
    return o.select("page", "n", F.array(word(F.lit("Order"), 10), word(F.col("k"), 110)).alias("words"))


def page_of(lines: DataFrame, line: Column, gap: str) -> DataFrame:
    """(page, body) with the text of all lines in order."""
    return lines.select("page", F.struct("n", line.alias("line")).alias("x")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), gap).alias("body"))


@query(WORDS_SQL)
def markup_words(spark: SparkSession, d: str) -> DataFrame:
    word = lambda w: F.format_string('<word xMin="%d.000000" yMin="%d.000000" xMax="%d.000000" yMax="%d.000000">%s</word>', w["left"], w["top"], w["right"], w["bottom"], w["text"])
    bodies = page_of(order_lines(spark, d), F.concat(F.lit("<line>"), F.array_join(F.transform("words", word), ""), F.lit("</line>")), "")
    markup = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><body><doc><page width="600" height="4000"><flow><block>'), "body", F.lit("</block></flow></page></doc></body></html>"))
    return geometry.markup_words(bodies.select("page", markup.alias("markup")), ["page"]).drop("fault")


@query(WORDS_SQL)
def tsv_words(spark: SparkSession, d: str) -> DataFrame:
    row = lambda w, i: F.format_string("5\t1\t7\t3\t%d\t%d\t%d\t%d\t%d\t%d\t90.5\t%s", F.col("n") * 2, i + 1, w["left"], w["top"], w["right"] - w["left"], w["bottom"] - w["top"], w["text"])
    bodies = page_of(order_lines(spark, d), F.array_join(F.transform("words", row), "\n"), "\n")
    tsv = F.concat(F.lit("\t".join(geometry.TSV_COLUMNS) + "\n1\t1\t0\t0\t0\t0\t0\t0\t600\t4000\t-1\t\n"), "body", F.lit("\n"))
    return geometry.tsv_words(bodies.select("page", tsv.alias("tsv"), F.lit(600).alias("pixel_width"), F.lit(4000).alias("pixel_height")), ["page"]).drop("fault")


@query("""SELECT l_orderkey, l_linenumber, CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'geometry_text_unverified' WHEN 2 THEN 'geometry_invalid' WHEN 3 THEN 'geometry_invalid' END AS fault FROM lineitem WHERE l_partkey % 6 <> 0""")
def geometry_faults(spark: SparkSession, d: str) -> DataFrame:
    """A page for each line item: one without words, one with a word of two parts, one out of bounds, one without its page's row, and
    two that are right."""
    k = F.col("l_partkey") % 6
    word = F.format_string("5\t1\t1\t1\t1\t1\t%d\t10\t20\t10\t90\t%s", F.when(k == 2, 590).otherwise(10), F.when(k == 1, "two parts").otherwise("one"))
    page = F.when(k == 3, "").otherwise("1\t1\t0\t0\t0\t0\t0\t0\t600\t4000\t-1\t\n")
    tsv = F.concat(F.lit("\t".join(geometry.TSV_COLUMNS) + "\n"), page, F.when(k == 0, "").otherwise(word))
    # Line items may share an order and a number: each is a page of its own.
    pages = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.monotonically_increasing_id().alias("page"), tsv.alias("tsv"), F.lit(600).alias("pixel_width"), F.lit(4000).alias("pixel_height"))
    return geometry.tsv_words(pages, ["l_orderkey", "l_linenumber", "page"]).select("l_orderkey", "l_linenumber", "fault")


@query("SELECT c_custkey, c_custkey % 5 IN (0, 4) AS mapped FROM customer")
def page_mappings(spark: SparkSession, d: str) -> DataFrame:
    """A page for each customer: upright, turned, cropped, of another size, and one whose file has but this page."""
    k = F.col("c_custkey")
    size = lambda w: F.format_string("%.2f %.2f", w, F.lit(841.8898))
    width = 500 + (k % 100) * 1.0006
    name = F.when(k % 5 == 4, "").otherwise(F.concat(F.lit("Page "), k, F.lit(" ")))
    info = F.concat(
        F.lit("Producer: x\n"), F.when(k % 5 == 4, "Page").otherwise(F.concat(F.lit("Page "), k)), F.when(k % 5 == 1, " rot: 90\n").otherwise(" rot: 0\n"),
        name, F.lit("MediaBox: 0.00 0.00 "), size(width), F.lit("\n"), name, F.lit("CropBox: 0.00 "), F.when(k % 5 == 2, "1.00 ").otherwise("0.00 "), size(width), F.lit("\n"),
    )
    dots = F.ceil(width * 200 / 72) + F.when(k % 5 == 3, 1).otherwise(0)
    return t(spark, d, "customer").select("c_custkey", geometry.mapping_verified(info, k, width, F.lit(841.8898), dots, F.lit(2339)).alias("mapped"))


# Catalogue, retention and evaluation over states derived from orders.


@query("""SELECT p_brand AS "table", string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS columns, 'declared_foreign_key_to_patient_table_or_identifier' AS evidence
FROM part WHERE p_size % 3 = 0 OR p_size % 5 = 0 GROUP BY 1""")
def patient_key_columns(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a foreign key of its brand's table: some refer to a table of patients, some to a column of them."""
    size = F.col("p_size")
    to = F.when(size % 3 == 0, "ward_patients").otherwise("wards")
    keys = t(spark, d, "part").select(F.col("p_brand").alias("table"), to.alias("referred_table"), F.array(F.when(size % 5 == 0, "Patient_ID").otherwise("id")).alias("referred_columns"), F.array("p_type").alias("constrained_columns"))
    return columns.patient_columns(keys).select("table", F.array_join("columns", ",").alias("columns"), F.array_join("evidence", ",").alias("evidence"))


def scan_states(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scans: an open one is queued, a half-delivered one is running."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query("SELECT o_orderkey AS scan_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def scans_newest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.newest(scan_states(spark, d)).select("scan_id")


@query("SELECT o_orderkey AS scan_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def scan_next(spark: SparkSession, d: str) -> DataFrame:
    return catalog.oldest_queued(scan_states(spark, d)).select("scan_id")


@query("SELECT o_orderkey AS scan_id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'interrupted' ELSE 'completed' END AS status FROM orders")
def scans_drained(spark: SparkSession, d: str) -> DataFrame:
    return retention.drained(scan_states(spark, d)).select("scan_id", "status")


@query("SELECT l_orderkey AS scan_id, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100)")
def content_purged(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the scans that one pass of retention leaves."""
    gone, _ = retention.purge(scan_states(spark, d), F.lit("1996-01-01").cast("timestamp"))
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), "l_linenumber", "l_partkey")
    return retention.without_content(lines, gone)


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_orderdate > TIMESTAMP '1996-01-01'")
def sessions_live(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sessions of customers; those in debt are no longer active."""
    sessions = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("username"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    users = t(spark, d, "customer").select(F.col("c_custkey").alias("username"), (F.col("c_acctbal") > 0).alias("active"))
    return retention.live_sessions(sessions, users, F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query("SELECT s_suppkey, s_name AS host, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '[redacted]' END AS password FROM supplier")
def sources_redacted(spark: SparkSession, d: str) -> DataFrame:
    secret = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("s3cret")
    sources = t(spark, d, "supplier").select("s_suppkey", F.create_map(F.lit("host"), F.col("s_name"), F.lit("password"), secret).alias("config"))
    return catalog.redacted(sources, "admin").select("s_suppkey", F.col("config")["host"].alias("host"), F.col("config")["password"].alias("password"))


METRICS_SQL = "(SELECT o_orderpriority AS label, count(*) FILTER (o_orderkey % 2 = 0) AS tp, count(*) FILTER (o_orderkey % 2 = 1 AND o_orderstatus = 'P') AS fp, count(*) FILTER (o_orderkey % 101 = 0) AS fn, count(*) FILTER (o_orderkey % 7 = 0) AS tn FROM orders GROUP BY 1)"


@query(f"""SELECT label, concat_ws(',', CASE WHEN tp + fn < 30 THEN 'positive_evidence_insufficient' END, CASE WHEN fp + tn < 30 THEN 'negative_evidence_insufficient' END, CASE WHEN label LIKE '5%' THEN 'coverage_incomplete' END,
CASE WHEN coalesce(tp / (tp + fp), 0) < 0.95 THEN 'precision_below_target' END, CASE WHEN coalesce(tp / (tp + fn), 0) < 0.95 THEN 'recall_below_target' END) AS blockers FROM {METRICS_SQL}""")
def eval_blockers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    counts = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count_if(k % 2 == 0).alias("tp"), F.count_if((k % 2 == 1) & (F.col("o_orderstatus") == "P")).alias("fp"), F.count_if(k % 101 == 0).alias("fn"), F.count_if(k % 7 == 0).alias("tn"))
    rates = counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "complete": ~F.col("label").startswith("5")})
    return evaluate.blockers(rates).select("label", F.array_join("blockers", ",").alias("blockers"))


@query("SELECT l_orderkey AS object, l_returnflag AS label, l_linestatus AS reason FROM lineitem WHERE l_orderkey % 3 <> 0")
def eval_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Lines as observations; the findings of every third order count one more than was observed."""
    seen = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("object"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("reason"))
    found = seen.groupBy("object", "label", "reason").agg((F.count("*") + F.when(F.col("object") % 3 == 0, 1).otherwise(0)).alias("match_count"))
    return evaluate.reconciled(seen, found)


@query(f"""SELECT page, id, sum(s) OVER (PARTITION BY page, top ORDER BY "left", "right" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM
(SELECT *, CASE WHEN n = 1 OR "left" - p >= 4 * 0.021 THEN 1 ELSE 0 END AS s FROM (SELECT *, row_number() OVER w AS n, lag("right") OVER w AS p FROM {BOX_SQL} WINDOW w AS (PARTITION BY page, top ORDER BY "left", "right")))""")
def line_runs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.horizontal_runs(boxes(spark, d).withColumn("height", F.lit(0.021)), ["page", "top"]).select("page", "id", "run")


@query(f"""SELECT page, id, k % 7 <> 0 AND least(0.04, 0.04 - x) >= 0.8 * 0.04 AND 2 * x <= 0.04 AS same FROM (SELECT *, id // 100000 AS k, (id // 100000 % 4) * 0.007::DOUBLE AS x FROM {BOX_SQL}) WHERE "left" < 0.9""")
def words_seen_twice(spark: SparkSession, d: str) -> DataFrame:
    """Each word and itself read again, a little to the right, and sometimes as another word."""
    b = boxes(spark, d).where(F.col("left") < 0.9).withColumn("k", F.floor(F.col("id") / 100000))
    shift = (F.col("k") % 4) * 0.007
    a = F.struct(F.lit("word").alias("text"), "left", "top", (F.col("left") + 0.04).alias("right"), (F.col("top") + 0.02).alias("bottom"))
    again = F.struct(F.when(F.col("k") % 7 == 0, "other").otherwise("word").alias("text"), (F.col("left") + shift).alias("left"), "top", (F.col("left") + 0.04 + shift).alias("right"), (F.col("top") + 0.02).alias("bottom"))
    return b.select("page", "id", a.alias("a"), again.alias("b")).select("page", "id", spatial.same_word("a", "b").alias("same"))


# Control of scans, comparison as shown, and key-value tables.

CUSTOMER_SCANS_SQL = "(SELECT o_orderkey AS scan_id, o_custkey AS source_id, CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'interrupted' ELSE 'completed' END AS status FROM orders)"


def customer_scans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scans of their customers, with a heartbeat on the day of the order."""
    r = F.col("o_orderkey") % 5
    status = F.when(r == 0, "queued").when(r == 1, "running").when(r == 2, "paused").when(r == 3, "interrupted").otherwise("completed")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("source_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("heartbeat_at"))


@query(f"""SELECT scan_id, a AS action, CASE WHEN a = 'pause' AND status IN ('queued', 'running') THEN 'paused' WHEN a = 'resume' AND status = 'paused' AND o_orderdate >= TIMESTAMP '1996-01-01' THEN 'running'
WHEN a = 'resume' AND status IN ('paused', 'interrupted') THEN 'queued' WHEN a = 'cancel' AND status <> 'completed' THEN 'cancelled' ELSE status END AS status,
CASE WHEN a IS NOT NULL THEN (a = 'pause' AND status IN ('queued', 'running')) OR (a = 'resume' AND status IN ('paused', 'interrupted')) OR (a = 'cancel' AND status <> 'completed') END AS accepted
FROM {CUSTOMER_SCANS_SQL} JOIN (SELECT o_orderkey AS scan_id, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' WHEN 2 THEN 'cancel' END AS a FROM orders) USING (scan_id)""")
def scan_actions(spark: SparkSession, d: str) -> DataFrame:
    """Each scan but every fourth is asked twice; the first request counts."""
    scans = customer_scans(spark, d)
    k = F.col("scan_id")
    first = F.when(k % 4 == 0, "pause").when(k % 4 == 1, "resume").when(k % 4 == 2, "cancel")
    asked = scans.where(k % 4 != 3).select("scan_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), first.alias("action")), F.struct(F.lit(2).alias("at"), F.lit("cancel").alias("action")))).alias("x")).select("scan_id", "x.*")
    now = F.lit("1996-01-01").cast("timestamp") + F.make_dt_interval(secs=F.lit(29))
    return control.acted(scans, asked, now).select("scan_id", "action", "status", "accepted")


@query(f"SELECT c_custkey AS source_id, CASE WHEN c_acctbal <= 0 THEN 'source_disabled' WHEN c_custkey IN (SELECT source_id FROM {CUSTOMER_SCANS_SQL} WHERE status IN ('queued', 'running', 'paused')) THEN 'active_scan' END AS refusal FROM customer")
def scan_refusals(spark: SparkSession, d: str) -> DataFrame:
    sources = t(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    return control.refusals(sources, customer_scans(spark, d)).select("source_id", "refusal")


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01') AS scans, (SELECT count(*) FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events)) AS sessions,
(SELECT count(*) FROM lineitem WHERE l_shipdate + INTERVAL 365 DAY <= TIMESTAMP '1996-01-01') AS audit""")
def catalogue_expired(spark: SparkSession, d: str) -> DataFrame:
    """Lines as audit entries; events, moved so that ten days of them have passed, as sessions."""
    now = F.lit("1996-01-01").cast("timestamp")
    events = t(spark, d, "events").select("ts")
    moved = events.join(F.broadcast(events.agg(F.min("ts").alias("least")))).select((now + (F.col("ts") - F.col("least")) - F.make_dt_interval(F.lit(10))).alias("expires_at"))
    return control.expired_counts(scan_states(spark, d), moved, t(spark, d, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("at")), now)


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100)")
def sessions_purged(spark: SparkSession, d: str) -> DataFrame:
    sessions = t(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    return control.sessions_left(sessions, F.lit("1996-01-01").cast("timestamp")).select("session_id")


@query("SELECT o_orderkey AS audit_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 365 DAY <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100)")
def audit_purged(spark: SparkSession, d: str) -> DataFrame:
    audit = t(spark, d, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return control.audit_left(audit, F.lit("1996-01-01").cast("timestamp")).select("audit_id")


@query("SELECT o_clerk AS actor, 'scan_' || CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'done' END AS action, '{\"scan_id\":' || o_orderkey || ',\"source_id\":' || o_custkey || '}' AS detail FROM (SELECT *, 'clerk' || o_custkey % 7 AS o_clerk FROM orders)")
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "orders").withColumns({"scan_id": F.col("o_orderkey"), "source_id": F.col("o_custkey")})
    action = F.concat(F.lit("scan_"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done"))
    return control.trail(events, F.concat(F.lit("clerk"), F.col("o_custkey") % 7), action, F.col("o_orderdate"), "scan_id", "source_id").drop("at")


@query(f"SELECT scan_id FROM {CUSTOMER_SCANS_SQL} WHERE source_id = (SELECT o_custkey FROM orders WHERE o_orderkey = 1) AND scan_id <> 1")
def comparison_candidates(spark: SparkSession, d: str) -> DataFrame:
    return control.candidates(customer_scans(spark, d), 1).select("scan_id")


@query("""WITH c AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'coverage_lost' WHEN 1 THEN 'not_comparable' WHEN 2 THEN 'changed' ELSE 'unchanged' END AS change, o_orderkey % 7 <> 0 AS ok FROM orders),
p AS (SELECT l_orderkey AS k, count(*) FILTER (l_quantity <> l_tax * 100) AS x, count(*) FILTER (l_quantity = l_tax * 100) AS y, bool_or(l_linenumber = 6) AS bad FROM lineitem GROUP BY 1),
r AS (SELECT c.*, x, y, CASE WHEN c.k % 5 < 2 THEN 'coverage_insufficient' WHEN NOT ok THEN 'findings_unavailable' WHEN coalesce(bad, false) THEN 'counts_unavailable' END AS reason FROM c LEFT JOIN p USING (k))
SELECT k AS object_key, change, reason, CASE WHEN reason IS NULL THEN coalesce(x, 0) END AS changed, CASE WHEN reason IS NULL THEN coalesce(y, 0) END AS unchanged FROM r""")
def deltas_shown(spark: SparkSession, d: str) -> DataFrame:
    """Lines as deltas of their orders; a sixth line has a count that can't be read."""
    k = F.col("o_orderkey")
    change = F.when(k % 5 == 0, "coverage_lost").when(k % 5 == 1, "not_comparable").when(k % 5 == 2, "changed").otherwise("unchanged")
    changes = t(spark, d, "orders").select(k.alias("object_key"), change.alias("change"), (k % 7 != 0).alias("comparable"))
    same = F.col("l_quantity") == F.col("l_tax") * 100
    deltas = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_key"), F.when(same, "unchanged").otherwise("changed").alias("change"), F.when(F.col("l_linenumber") == 6, -1).otherwise(1).alias("before_count"), F.lit(1).alias("after_count"))
    return control.shown_deltas(changes, deltas)


def key_value(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 2 == 0, "diabetes").otherwise("none")
    return t(spark, d, "customer").select(F.col("c_mktsegment").alias("PartitionKey"), F.lpad(k.cast("string"), 12, "0").alias("RowKey"), F.concat(F.lit("C000"), k).alias("mrn"), said.alias("diagnosis"))


ENTITY_SQL = """(SELECT c_custkey AS k, sha256('["' || c_mktsegment || '","' || lpad(c_custkey::VARCHAR, 12, '0') || '"]') AS object FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1000)"""


@query(f"SELECT object AS location, 'full' AS status, NULL AS reason, 1::BIGINT AS examined FROM {ENTITY_SQL} UNION ALL SELECT '[cloud-coverage]', CASE WHEN n > 1000 THEN 'sampled' ELSE 'full' END, CASE WHEN n > 1000 THEN 'bounded_prefix_sample' END, least(n, 1000) FROM (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING')")
def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The feature itself is bounded: the first 1,000 entities of a partition, with a row that says so."""
    return columns.scan_entities(key_value(spark, d), partition="BUILDING")[0]


@query(f"""SELECT object, 'MRN' AS entity_type, 'personal_data' AS classification, 1::BIGINT AS match_count, 'property:mrn' AS segment FROM {ENTITY_SQL}
UNION ALL SELECT object, 'HEALTH_INFORMATION', 'patient_linked_health', CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END, 'property:diagnosis' FROM {ENTITY_SQL}""")
def entity_findings(spark: SparkSession, d: str) -> DataFrame:
    """An entity's diagnosis is linked by the identifier among its own properties."""
    return columns.scan_entities(key_value(spark, d), partition="BUILDING")[1].select("object", "entity_type", "classification", "match_count", "segment")
