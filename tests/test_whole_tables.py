"""Queries look at all rows of their tables: what they give equals brute force over every row."""

import collections
import itertools
import statistics
from pathlib import Path

import duckdb
import pytest

from veilscan.operators import spatial
from veilscan.plans.queries import REGISTRY

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def pages():
    """page: (id, left, top, right, bottom) of every row of lineitem."""
    found = collections.defaultdict(list)
    rows = duckdb.sql(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from '{TABLES}/lineitem.parquet'").fetchall()
    for order, line, part, page, quantity in rows:
        left, top = (part % 97) / 100.0, (quantity * 13 % 89) / 100.0
        found[page].append(((order * 10 + line) * 100000 + part, left, top, min(1.0, left + 0.04), min(1.0, top + 0.02)))
    assert sum(map(len, found.values())) == len(rows) == 6000
    return found


def test_every_box_meets_every_other(spark, pages):
    want = collections.Counter()
    for page, boxes in pages.items():
        for a, b in itertools.combinations(sorted(boxes), 2):
            if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]:
                want[page, a[0], b[0]] += 1
    assert collections.Counter(map(tuple, REGISTRY["box_overlaps"][0](spark, str(TABLES)).collect())) == want


def test_every_word_has_its_owner(spark, pages):
    want = collections.Counter()
    for page, boxes in pages.items():
        for word, left, _, right, _ in boxes:
            inside = [i for i in (1, 2, 3) if (i - 1) / 4 <= (left + right) / 2 <= i / 4]
            want[page, word, inside[0] if len(inside) == 1 else None] += 1
    assert collections.Counter(map(tuple, REGISTRY["rectangle_owners"][0](spark, str(TABLES)).collect())) == want


def test_every_word_is_within_the_bounds(spark, pages):
    want = {p: (min(b[1] for b in x), min(b[2] for b in x), max(b[3] for b in x), max(b[4] for b in x), round(statistics.median(b[4] - b[2] for b in x), 9)) for p, x in pages.items()}
    assert {r[0]: tuple(r)[1:] for r in REGISTRY["page_bounds"][0](spark, str(TABLES)).collect()} == want


def test_words_that_share_an_id_keep_their_owners(spark):
    words = spark.createDataFrame([(1, 7, 0.0, 0.1), (1, 7, 0.0, 0.1), (1, 7, 0.6, 0.7), (1, 8, 0.4, 0.6)], "page int, id int, left double, right double").selectExpr("*", "0.0D as top", "0.1D as bottom")
    halves = spark.createDataFrame([(1, 1, 0.0, 0.5), (1, 2, 0.5, 1.0)], "page int, id int, left double, right double").selectExpr("*", "0.0D as top", "1.0D as bottom")
    assert sorted(map(str, map(tuple, spatial.owners(words, halves, "page").collect()))) == ["(1, 7, 1)", "(1, 7, 1)", "(1, 7, 2)", "(1, 8, None)"]


def test_every_row_is_searched_for_references(spark):
    tables = TABLES.with_name("sf0.01")
    keys = [k for (k,) in duckdb.sql(f"select c_custkey from '{tables}/customer.parquet'").fetchall()]
    said = lambda of: sum(1 + (k % 5 != 0) for k in of)
    other = [k for k in keys if k % 3 == 0]
    want = {("visits/mrn", "MRN", "personal_data", len(keys)), ("visits/diagnosis", "MRN", "personal_data", len(other)), ("visits/diagnosis", "HEALTH_INFORMATION", "clinical_content", said(other)), ("visits/diagnosis", "HEALTH_INFORMATION", "patient_linked_health", said(k for k in keys if k % 3))}
    assert len(keys) == 1500 and {(r["location"], r["entity_type"], r["classification"], r["match_count"]) for r in REGISTRY["row_references"][0](spark, str(tables)).collect()} == want
