import pytest

from veilscan.functions.recognizers import RULES, luhn, spans_of, verhoeff
from veilscan.operators.findings import Context, detect, evidence

HEALTH = "HEALTH_INFORMATION"


def found(spark, text, context=Context(), **columns):
    schema = "id string, t string" + "".join(f", {k} {v}" for k, (_, v) in columns.items())
    df = spark.createDataFrame([("x", text, *[v for v, _ in columns.values()])], schema)
    return {(r["entity_type"], r["classification"], r["segment"], r["match_count"]) for r in detect(df, "id", "t", context).collect()}


@pytest.mark.parametrize(("digits", "valid"), [("234567890124", True), ("234567890123", False)])
def test_verhoeff(digits, valid):
    assert verhoeff(digits) is valid


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


@pytest.mark.parametrize("text", ["1" * 12, "23456789012345"])
def test_no_identity_number(text):
    assert not spans_of(text, 0, False, "", "", RULES)


@pytest.mark.parametrize("n", [0, 11738, 11744, 11985, 11990, 11995])
def test_identifier_near_a_cut_counts_once(spark, n):
    assert found(spark, " " * n + "MRN: R12345 " + "x" * 20000) == {("MRN", "personal_data", "segment:1/block:1/row:1", 1)}


def test_pages_keep_people_apart(spark):
    got = found(spark, "MRN: R12345\fdiabetes")
    assert (HEALTH, "clinical_content", "segment:2/block:1/row:1", 1) in got
    got = found(spark, "MRN: A123\nDiagnosis\fMRN: B456\nDiagnosis")
    assert sum(x[:2] == (HEALTH, "patient_linked_health") for x in got) == 2


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_patient_header_starts_a_record(spark, end):
    got = found(spark, f"MRN: A123{end}seen{end}Patient Name = Ann{end}Diagnosis: none")
    assert (HEALTH, "clinical_content", "segment:1/block:2/row:1", 1) in got


def test_two_identifiers_are_ambiguous(spark):
    df = spark.createDataFrame([("x", "MRN: A12345 UHID: B23456 diagnosis")], "id string, t string")
    assert {r["reason"] for r in detect(df, "id", "t").where("entity_type = 'HEALTH_INFORMATION'").collect()} == {"clinical_content_with_ambiguous_patient_references"}


def test_context_links_and_structure_drops_it(spark):
    refs = ([("PATIENT_REFERENCE", "7")], "array<struct<kind:string,value:string>>")
    context = Context(column="c", references="r")
    assert found(spark, "diagnosis: none", context, c=("diagnosis", "string"), r=refs) == {(HEALTH, "patient_linked_health", "segment:1/block:1/row:1", 1)}
    assert found(spark, "unremarkable", context, c=("diagnosis", "string"), r=refs) == {(HEALTH, "patient_linked_health", "segment:1/block:1/row:1", 1)}
    assert found(spark, "unremarkable", context, c=("discharge_diagnosis", "string"), r=refs) == set()
    assert found(spark, '{"note": "diagnosis"}', context, c=("x", "string"), r=refs) == {(HEALTH, "clinical_content", "segment:1/block:1/row:1", 1)}
    assert found(spark, "MRN: other1 diagnosis", context, c=("x", "string"), r=refs) == {("MRN", "personal_data", "segment:1/block:1/row:1", 1), (HEALTH, "clinical_content", "segment:1/block:1/row:1", 1)}


def test_nothing_in_nulls_and_empties(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "  ")], "id string, t string")
    assert detect(df, "id", "t").count() == 0 and detect(df.limit(0), "id", "t").count() == 0


def test_no_values_are_kept_and_evidence_is_bounded(spark):
    text = "mail a1@example.com b2@example.com c3@example.com d4@example.com"
    df = spark.createDataFrame([("x", text)], "id string, t string")
    assert "example.com" not in str(detect(df, "id", "t").collect())
    shown = evidence(df, "id", "t").orderBy("example").collect()
    assert [r["value"] for r in shown] == ["a1@example.com", "b2@example.com", "c3@example.com"]
    assert text[shown[2]["start"] : shown[2]["end"]] == "c3@example.com"


def test_same_result_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, f"MRN: A{i:04d}\nDiagnosis diabetes\n\n" * 30) for i in range(20)], "id int, t string")
    assert sorted(detect(df.repartition(1), "id", "t").collect()) == sorted(detect(df.repartition(8), "id", "t").collect())
