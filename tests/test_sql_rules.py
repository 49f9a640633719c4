"""SQL and query state one rule on texts and keys that the small tables don't have."""

import duckdb
import pandas as pd
import pytest

from tests.test_queries import plain
from veilscan.plans.queries import REGISTRY

TEXTS = [
    'token = "9885103314b39ed955fd8ac9efa74c6fd87b66ee" and a.b@c.org', 'token = "86a31e945411267126c0174875cf8d131e277982"', "a@b.co c@d.co,e@f.co g@h.co", "9885103314@mail.org +91 98851 03314 9885103314 9885103315", "98851 03314@mail.org, 2222 2222 2222",
    "ABCPK1234F abcpk1234f xABCPK1234F", "no one", "", None, "9454 1126 7126 9454-1126-7126 94541126712 945411267127", "x" * 11_990 + " a@b.co " + "y" * 12_000 + " 9885103314",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("rules")
    pd.DataFrame({"doc_id": range(1, len(TEXTS) + 1), "text": TEXTS}).to_parquet(d / "documents.parquet")
    pd.DataFrame({"c_custkey": [*range(60), *range(700_000, 700_060)]}).to_parquet(d / "customer.parquet")
    return d


@pytest.mark.parametrize("name", ["checksum_identifiers", "scan_findings", "evidence_top3", "findings_listing", "findings_search", "object_finding_counts", "overview_counts", "reviews_applied"])
def test_same_rule(spark, tables, name):
    con = duckdb.connect()
    for f in tables.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    query, sql = REGISTRY[name]
    found = plain(query(spark, str(tables)).toPandas())
    assert found[1] and found == plain(con.sql(sql).df())
